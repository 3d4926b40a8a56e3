"""Search schemes and the choice of seeds."""
