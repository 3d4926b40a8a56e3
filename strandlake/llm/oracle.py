"""DuckDB SQL for the queries of this subpackage that SQL expresses."""

from __future__ import annotations

from . import collocations, decontaminate, fingerprints, licenses, quality, secrets


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def jaccard() -> str:
    return r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = d.doc_id)::BIGINT AS n_links FROM documents d"""


def secret_scan() -> str:
    def spans(pattern: str, group: int = 0) -> str:
        p = _text(pattern)
        return f"CASE WHEN regexp_matches(t, {p}) THEN list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{'start': (list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i - 1], lambda x: length(x))), 0))::BIGINT, 'hit': regexp_extract_all(t, {p})[i], 'value': regexp_extract_all(t, {p}, {group})[i]}}) ELSE [] END"

    one = " UNION ALL ".join(f"SELECT rid, owner, {k} AS k, unnest({spans(p, g)}) AS s FROM d" for k, (p, g) in enumerate(((secrets.ASSIGN, 2), (secrets.ACCESS, 0), (secrets.HEX, 0), (secrets.OPAQUE, 0))))
    live = f"(regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT})"
    kind = f"[{', '.join(map(_text, secrets.KINDS))}][k + 1]"
    join = f"coalesce(string_agg({kind} || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (WHERE {{}}), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
f AS ({one}),
c AS (SELECT rid, owner, k, s.start AS start, s.start + length(s.hit) AS stop, s.value AS value FROM f),
v AS (SELECT *, {live} AS live FROM c WHERE (k <> 0 OR length(value) >= {secrets.MIN_ASSIGN}) AND (k <> 3 OR {live})),
x AS (SELECT * FROM v WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM v b WHERE b.rid = v.rid AND b.k < 3 AND b.start < v.stop AND v.start < b.stop)),
o AS (SELECT value, count(DISTINCT owner) <= {min(secrets.MAX_OWNERS, secrets.MAX_REPOS)} AS few FROM x GROUP BY 1),
y AS (SELECT x.*, o.few FROM x JOIN o USING (value)),
a AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, {join.format('k < 3')} AS base, {join.format('k < 3 OR (few AND live)')} AS spans, count(*) FILTER (WHERE few AND live) AS n_owned, count(*) FILTER (WHERE NOT few) AS n_copied FROM y GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0)::BIGINT AS n_owned, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN a USING (rid)"""


def quality_rules() -> str:
    q = quality
    count = lambda keep: f"length(regexp_replace(t, '{keep}', '', 'g'))::BIGINT"
    js = lambda p, r: f"(SELECT CASE WHEN list_sum({p}) > 0 AND list_sum({r}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {_js_term(p, r)})) / 2, 0)) ELSE 0 END)"
    n_char, n_word = len(q.CHAR_CLASSES), q.N_WORDS + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
cw AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(t), '\p{{L}}+'))) AS w FROM d WHERE lang IS NOT NULL) GROUP BY 1, 2),
ck AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM cw),
cl AS (SELECT lang, list(w ORDER BY k) AS listed FROM ck WHERE k <= {q.N_WORDS} GROUP BY 1),
w AS (SELECT *, regexp_extract_all(t, '{q.WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d LEFT JOIN cl USING (lang)),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
p AS (SELECT rid, count(DISTINCT x)::BIGINT AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS x FROM h WHERE n > 1) GROUP BY 1),
b AS (SELECT w.rid, doc_id, lang, len(w)::BIGINT AS n_words, {count(q.GAP)} AS word_chars, {count('[^#*$%&|<>]+')} AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
 {count('[^A-Z]+')} AS upper, {count('[^0-9]+')} AS digit, {count('[^!-/:-@\\[-`{-~]+').replace(chr(92) * 2, chr(92))} AS mark, {count('[\\x00-\\x7f]+').replace(chr(92) * 2, chr(92))} AS other, length(t)::BIGINT AS n_chars, listed, list_filter(regexp_extract_all(lower(t), '\p{{L}}+'), lambda x: list_contains(listed, x)) AS m FROM w LEFT JOIN p USING (rid)),
f AS (SELECT *, [word_chars - upper - digit - mark - other, upper, digit, mark, other, n_chars - word_chars]::DOUBLE[] AS c, CASE WHEN listed IS NOT NULL THEN list_append(list_transform(listed, lambda x: len(list_filter(m, lambda y: y = x))), greatest(n_words - len(m), 0))::DOUBLE[] END AS v, n_words >= {q.MIN_WORDS} AND 100 * n_repeat_words <= {q.MAX_REPEAT_PERCENT} * n_words AS passed FROM b),
r AS (SELECT lang, sum(n_words) AS ref_n, {sums('c', n_char)} AS rc, {sums('v', n_word)} AS rv FROM f WHERE passed AND lang IS NOT NULL GROUP BY 1),
j AS (SELECT f.*, coalesce(ref_n, 0) AS ref_n, coalesce({js('c', 'rc')}, 0) AS dc, coalesce({js('v', 'rv')}, 0) AS dv FROM f LEFT JOIN r USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT passed AS base_failed, passed AND (n_words < {q.GUARD_WORDS} OR ref_n < {q.GUARD_REFERENCE} OR (dc <= {q.CHAR_LIMIT} + {q.CHAR_NOISE} / sqrt(5.0 * greatest(n_words, 1)) AND dv <= {q.WORD_LIMIT} + {q.WORD_NOISE} / sqrt(greatest(n_words, 1)))) AS kept FROM j"""


def _js_term(p: str, r: str) -> str:
    x, y = f"{p}[i] / list_sum({p})", f"{r}[i] / list_sum({r})"
    m = f"(({x} + {y}) / 2)"
    return f"CASE WHEN {p}[i] > 0 THEN {x} * log2({x} / {m}) ELSE 0 END + CASE WHEN {r}[i] > 0 THEN {y} * log2({y} / {m}) ELSE 0 END"


def decontamination() -> str:
    """Exact: every window of an item's length that shares a shingle with it, by weighted Jaccard similarity."""
    words = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {words} AS w, least({decontaminate.SHINGLE}, len({words})) AS size FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT item_id, size, len(w) AS n, array_to_string(w[p:p + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM i WHERE len(w) > 0)),
ic AS (SELECT item_id, size, n, g, count(*) AS c FROM ig GROUP BY ALL),
dg AS (SELECT rid, len(w) AS m, size, p, array_to_string(w[p:p + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM i WHERE size > 0) WHERE len(w) >= size)),
h AS (SELECT rid, m, item_id, size, n, p, g, c FROM dg JOIN ic USING (size, g)),
s AS (SELECT DISTINCT rid, m, item_id, size, n, unnest(range(greatest(p - (n - size), 1), greatest(least(p, m - n + 1), greatest(p - (n - size), 1)) + 1)) AS s FROM h),
b AS (SELECT s.rid, s.item_id, s.size, s.s, least(s.n, s.m - s.s + 1) - s.size + 1 AS own, s.n - s.size + 1 AS span, h.g, least(count(*), any_value(h.c)) AS k FROM s JOIN h ON h.rid = s.rid AND h.item_id = s.item_id AND h.p BETWEEN s.s AND s.s + s.n - s.size GROUP BY ALL),
j AS (SELECT rid, item_id, size, s, own, sum(k) / (own + any_value(span) - sum(k)) AS sim FROM b GROUP BY rid, item_id, size, s, own),
t AS (SELECT *, row_number() OVER (PARTITION BY rid, item_id ORDER BY sim DESC, s) AS r FROM j WHERE sim >= {decontaminate.THRESHOLD}::DOUBLE)
SELECT doc_id, item_id, sim::DOUBLE AS similarity, (s - 1)::BIGINT AS first_word, (own + size - 1)::BIGINT AS n_words FROM t JOIN d USING (rid) WHERE r = 1"""


def line_dedup() -> str:
    # levenshtein counts bytes here, and a symbol has up to four: it leaves the pairs of which some place is tried by symbols.
    gone = lambda x: f"substr({x}, 1, i - 1) || substr({x}, i + 1)"
    tried = f"CASE WHEN length(a.l) = length(b.l) THEN {gone('a.l')} = {gone('b.l')} WHEN length(a.l) > length(b.l) THEN {gone('a.l')} = b.l ELSE a.l = {gone('b.l')} END"
    one = f"CASE WHEN levenshtein(a.l, b.l) <= 4 AND abs(length(a.l) - length(b.l)) <= 1 THEN len(list_filter(range(1, greatest(length(a.l), length(b.l)) + 1), lambda i: {tried})) > 0 ELSE false END"
    keys = "SELECT l, d0, l0, {n} AS n, 1 AS side, substr(l, 1, ({n}) // 2) AS h FROM q UNION ALL SELECT l, d0, l0, {n}, 2, right(l, ({n}) - ({n}) // 2) FROM q"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT rid, doc_id, i, ls[i] AS l, regexp_matches(ls[i], '[^\\x20\\x09-\\x0D]') AS seen FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)),
u AS (SELECT l, min({{'d': doc_id, 'i': i}}) AS f FROM o WHERE seen GROUP BY 1),
q AS (SELECT l, f.d AS d0, f.i AS l0 FROM u),
k AS ({keys.format(n='length(l)')} UNION ALL {keys.format(n='length(l) - 1')}),
near AS (SELECT DISTINCT a.l FROM k a JOIN k b ON a.n = b.n AND a.side = b.side AND a.h = b.h AND a.l <> b.l AND (b.d0 < a.d0 OR (b.d0 = a.d0 AND b.l0 < a.l0)) WHERE {one}),
x AS (SELECT o.*, near.l IS NOT NULL AS near, u.f.d AS d0, row_number() OVER (PARTITION BY rid, o.l ORDER BY o.i) AS nth FROM o LEFT JOIN u ON u.l = o.l LEFT JOIN near ON near.l = o.l),
y AS (SELECT *, seen AND (near OR d0 <> doc_id OR nth > 1) AS gone FROM x)
SELECT doc_id, count(*) FILTER (WHERE seen)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, count(*) FILTER (WHERE gone AND near AND d0 = doc_id)::BIGINT AS n_near, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM y GROUP BY rid, doc_id"""


def license_scan() -> str:
    t, most = licenses.THRESHOLD, licenses.longest_run()
    rows = [(name, g) for name, texts in sorted(licenses.ALL_TEMPLATES.items()) for g in map(licenses.bigrams_of, texts) if g]
    values = ", ".join(f"({_text(name)}, [{', '.join(map(_text, g))}])" for name, g in rows)
    least = min(len(g) for _, g in rows) * t / (2 - t)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m(name, g) AS (VALUES {values}),
l AS (SELECT rid, i, ls[i] AS l, len(regexp_extract_all(lower(ls[i]), '[a-z0-9]+')) AS n FROM (SELECT rid, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
c AS (SELECT rid, i, l, n, sum(n) OVER (PARTITION BY rid ORDER BY i) AS upto FROM l),
r AS (SELECT a.rid, string_agg(x.l, chr(10) ORDER BY x.i) AS u FROM c a JOIN c b ON a.rid = b.rid AND a.i < b.i AND a.n > 0 AND b.n > 0 AND b.upto - a.upto + a.n BETWEEN {least} AND {most} JOIN c x ON x.rid = a.rid AND x.i BETWEEN a.i AND b.i GROUP BY a.rid, a.i, b.i),
u AS (SELECT DISTINCT rid, u FROM (SELECT rid, unnest(list_concat(list_concat([t], string_split(t, chr(10))), string_split_regex(t, '\\n[\\x20\\t\\r]*\\n'))) AS u FROM d UNION ALL SELECT rid, u FROM r)),
w AS (SELECT rid, regexp_extract_all(lower(u), '[a-z0-9]+') AS w FROM u),
a AS (SELECT rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM w WHERE len(w) > 1),
s AS (SELECT rid, name, max(2.0::DOUBLE * len(list_intersect(a, g)) / (len(a) + len(g))) AS s FROM a JOIN m ON len(a) BETWEEN {t / (2 - t)} * len(g) - 1 AND {(2 - t) / t} * len(g) + 1 AND list_has_any(a, g) GROUP BY 1, 2),
b AS (SELECT rid, max(s) AS score, min({{'s': -s, 'name': name}}).name AS license, string_agg(name, ',' ORDER BY name) AS licenses FROM s WHERE s >= {t} GROUP BY 1)
SELECT doc_id, license, coalesce(score, 0.0::DOUBLE)::DOUBLE AS score, coalesce(licenses, '') AS licenses FROM d LEFT JOIN b USING (rid)"""


def fingerprint() -> str:
    # The primes of XXH64.
    p = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
    m, ctes = 1 << 64, []
    n = lambda x: f"{x % m}::UHUGEINT"
    low = lambda x: f"(({x}) & {m - 1}::UHUGEINT)"
    down = lambda x, k: f"(({x}) >> {k}::UHUGEINT)"
    times = lambda x, y: low(f"({x}) * {n(y)}")
    plus = lambda *xs: low(" + ".join(xs))
    rotl = lambda x, k: f"({times(x, 1 << k)} + {down(x, 64 - k)})"

    def step(source: str, name: str, **columns: str) -> str:
        ctes.append(f"{name} AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {source})")
        return name

    def mixed(source: str, name: str, column: str, out: str) -> str:
        """The last steps of a hash."""
        a = step(source, f"{name}a", **{f"{out}1": times(f"xor({column}, {down(column, 33)})", p[1])})
        b = step(a, f"{name}b", **{f"{out}2": times(f"xor({out}1, {down(out + '1', 29)})", p[2])})
        return step(b, f"{name}c", **{out: f"xor({out}2, {down(out + '2', 32)})"})

    def of_long(source: str, name: str, value: str, seed: str, out: str) -> str:
        a = step(source, f"{name}x", **{f"{out}_a": times(value, p[1])})
        b = step(a, f"{name}y", **{f"{out}_b": f"xor({plus(seed, n(p[4] + 8))}, {times(rotl(f'{out}_a', 31), p[0])})"})
        c = step(b, f"{name}z", **{f"{out}_c": plus(times(rotl(f"{out}_b", 27), p[0]), n(p[3]))})
        return mixed(c, name, f"{out}_c", out)

    # Words: the XXH64 of the 32 characters of their MD5.
    seeds = (42 + p[0] + p[1], 42 + p[1], 42, 42 - p[0])
    own = step("v0", "v1", r="hex(reverse(md5(x)))")
    own = step(own, "v2", **{f"l{k}": plus(n(seeds[k]), times(f"('0x' || substr(r, {49 - 16 * k}, 16))::UBIGINT::UHUGEINT", p[1])) for k in range(4)})
    own = step(own, "v3", **{f"s{k}": times(rotl(f"l{k}", 31), p[0]) for k in range(4)})
    own = step(own, "v4", z0=plus(rotl("s0", 1), rotl("s1", 7), rotl("s2", 12), rotl("s3", 18)), **{f"u{k}": times(f"s{k}", p[1]) for k in range(4)})
    own = step(own, "v5", **{f"q{k}": times(rotl(f"u{k}", 31), p[0]) for k in range(4)})
    for k in range(4):
        own = step(own, f"v6{k}", **{f"z{k + 1}": plus(times(f"xor(z{k}, q{k})", p[0]), n(p[3]))})
    own = step(own, "v7", y=plus("z4", n(32)))
    own = mixed(own, "v8", "y", "word")
    # Terms: five words' hashes, each with the one before as its seed; the second half hashes the first.
    terms = "t0"
    for k in range(fingerprints.SHINGLE):
        terms = of_long(terms, f"t{k + 1}", f"w{k}", f"e{k - 1}" if k else n(42), f"e{k}")
    terms = of_long(terms, "tg", f"e{fingerprints.SHINGLE - 1}", n(42), "g")
    split = r"list_filter(string_split_regex(lower(x), '[\x20\x09-\x0D]'), lambda w: w <> '')"
    cut = ctes
    words, hashed = cut[: next(i for i, c in enumerate(cut) if c.startswith("t1x "))], cut[next(i for i, c in enumerate(cut) if c.startswith("t1x ")) :]
    half = lambda e: "(" + " + ".join(f"CASE WHEN 2 * sum(({e} >> {b}) & 1) > count(*) THEN {n(1 << b)} ELSE 0::UHUGEINT END" for b in range(64)) + ")"
    bits = lambda a, b: f"(bit_count(xor({a}.hi, {b}.hi)::UBIGINT) + bit_count(xor({a}.lo, {b}.lo)::UBIGINT))"
    digits = lambda a: f"(lpad(lower(to_hex({a}.hi::UBIGINT)), 16, '0') || lpad(lower(to_hex({a}.lo::UBIGINT)), 16, '0'))"
    joins = " ".join(f"LEFT JOIN {own} j{k} ON j{k}.x = w[p + {k}]" for k in range(fingerprints.SHINGLE))
    word = ", ".join(f"coalesce(j{k}.word, 0::UHUGEINT) AS w{k}" for k in range(fingerprints.SHINGLE))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS rid, doc_id, coalesce(text, '') AS t FROM documents),
e AS MATERIALIZED (SELECT rid, doc_id, t, left(t, (length(t) - length(t) // 2)::INT) || left(coalesce(lead(t) OVER (ORDER BY rid), first_value(t) OVER (ORDER BY rid)), (length(t) // 2)::INT) AS edited FROM d),
x AS (SELECT rid, 0 AS side, t AS x FROM e UNION ALL SELECT rid, 1, edited FROM e),
w AS MATERIALIZED (SELECT rid, side, {split} AS w FROM x),
v0 AS (SELECT DISTINCT unnest(w) AS x FROM w),
{(","+chr(10)).join(words)},
s AS (SELECT rid, side, w, unnest(range(1, greatest(len(w) - {fingerprints.SHINGLE - 1}, 1) + 1)) AS p FROM w),
t0 AS (SELECT rid, side, {word} FROM s {joins}),
{(","+chr(10)).join(hashed)},
f AS MATERIALIZED (SELECT rid, side, {half('e')} AS hi, {half('g')} AS lo FROM (SELECT rid, side, e{fingerprints.SHINGLE - 1}::UBIGINT AS e, g::UBIGINT AS g FROM {terms}) GROUP BY 1, 2),
u AS (SELECT hi, lo, count(*) AS n_same FROM f WHERE side = 0 GROUP BY 1, 2),
y AS (SELECT a.hi, a.lo, any_value(a.n_same) AS n_same, count(b.hi) AS n_near FROM u a LEFT JOIN u b ON (a.hi <> b.hi OR a.lo <> b.lo) AND {bits('a', 'b')} <= {fingerprints.RADIUS} GROUP BY 1, 2)
SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, {digits('a')} AS fingerprint, {digits('b')} AS edited_fingerprint, (128 - {bits('a', 'b')}) / 128.0::DOUBLE AS near_edited, (128 - {bits('a', 'c')}) / 128.0::DOUBLE AS near_next, y.n_same::BIGINT AS n_same, y.n_near::BIGINT AS n_near
FROM e JOIN f a ON a.rid = e.rid AND a.side = 0 JOIN f b ON b.rid = e.rid AND b.side = 1 JOIN f c ON c.side = 0 AND c.rid = e.rid % (SELECT count(*) FROM d) + 1 JOIN y ON y.hi = a.hi AND y.lo = a.lo"""


def phrases() -> str:
    upper, q = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", collocations
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM o, (VALUES (1), (2), (3), (4)) AS v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {q.MIN_COUNT}),
c AS (SELECT lang, g, k, f, string_split(g, ' ') AS s, unnest(range(1, k)) AS j FROM g WHERE k > 1),
x AS (SELECT c.lang, c.g, c.f AS a, a.f AS l, b.f AS r, j, ({q.FACTOR}::HUGEINT * c.f) // (a.f + b.f) AS score FROM c JOIN g a ON a.lang = c.lang AND a.g = array_to_string(s[1:j], ' ') JOIN g b ON b.lang = c.lang AND b.g = array_to_string(s[j + 1:], ' ')),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS nth FROM x) WHERE nth = 1),
i AS (SELECT lang, f, array_to_string(s[b:b + m - 1], ' ') AS g FROM (SELECT lang, f, string_split(g, ' ') AS s, k, m, unnest(range(1, k - m + 2)) AS b FROM g, (VALUES (2), (3)) AS v(m) WHERE m < k)),
z AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.g) AS rank FROM y LEFT JOIN (SELECT lang, g, max(f) AS f FROM i GROUP BY 1, 2) i ON i.lang = y.lang AND i.g = y.g WHERE i.f IS NULL OR 100 * i.f < {q.COVERED} * a)
SELECT lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM z JOIN t USING (lang) WHERE rank <= {q.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": jaccard(), "op2_secret_scan": secret_scan(), "op5_quality_rules": quality_rules(), "op6_decontamination": decontamination(), "op9_line_dedup": line_dedup(), "op10_license_scan": license_scan(), "op11_phrase_collocations": phrases(), "op12_document_fingerprints": fingerprint()}
