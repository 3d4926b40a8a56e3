"""Plain-Python versions of what the operators return, for small inputs."""

import hashlib
import re
import zlib

SF = "/root/testdata/sf0.001"

ODD = [None, "", " ", "\n\n", "a", "word " * 200, "x" * 5000, "é" * 60 + "\n" + "é" * 60, "1 2 3", "🙂 " * 80, "\x00\x01", "Don't 'stop'\tme\r\nnow", "<|endoftext|> x"]


def frame(spark, texts, **more):
    """Documents with a null id, repeated ids and clashing extra columns."""
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, 7, "part", "h") for i, t in enumerate(texts)]
    rows += rows[-2:]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string, hash string")


SECRETS = {
    "assign": re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def base_secrets(text):
    text, out = text or "", []
    for k, (kind, p) in enumerate(SECRETS.items()):
        for m in p.finditer(text):
            if len(m.group(2) if kind == "assign" else m.group()) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def base_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    rep = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(words) < 50 or 100 * len(rep) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep), failed


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def sha(b):
    return hashlib.sha256(b).hexdigest()
