"""DuckDB SQL for the whole result of op1: XXH64 worked out in 128-bit arithmetic, fingerprints, links and components."""

from __future__ import annotations

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4

# The primes of XXH64.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261
WORD = 1 << 64


def _n(x: int | str) -> str:
    return f"({x})::UHUGEINT"


def _mul(a: str, b: int | str) -> str:
    return f"(({_n(a)} * {_n(b)}) % {_n(WORD)})"


def _add(a: str, b: int | str) -> str:
    return f"(({_n(a)} + {_n(b)}) % {_n(WORD)})"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"


def _turned(x: str, bits: int) -> str:
    return f"({_mul(x, 1 << bits)} + {_n(x)} // {_n(1 << (64 - bits))})"


def _round(acc: str, lane: str) -> str:
    return _mul(_turned(_add(acc, _mul(lane, P2)), 31), P1)


def _folded(x: str, bits: int) -> str:
    return _xor(x, f"{_n(x)} // {_n(1 << bits)}")


def _lane(hex_digits: str) -> str:
    """The number of bytes in hex, the least significant first."""
    pairs = f"list_transform(range(0, length({hex_digits}) // 2), lambda q: substr({hex_digits}, 2 * q + 1, 2))"
    return f"('0x0' || list_reduce(list_prepend('', {pairs}), lambda p, o: o || p))::UBIGINT::UHUGEINT"


def simhash_sql() -> str:
    starts = ", ".join(str(x % WORD) for x in (SEED + P1 + P2, SEED + P2, SEED, SEED - P1))
    whole = f"({' + '.join(_turned(f'v[{k}]', b) for k, b in ((1, 1), (2, 7), (3, 12), (4, 18)))}) % {_n(WORD)}"
    merged = _add(_mul(_xor("a", _round("0", "l")), P1), P4)
    eight = _add(_mul(_turned(_xor("a", _round("0", "l")), 27), P1), P4)
    four = _add(_mul(_turned(_xor("h", _mul("four", P1)), 23), P2), P3)
    one = _mul(_turned(_xor("a", _mul("l", P5)), 11), P1)
    last = _folded(_mul(_folded(_mul(_folded("h", 33), P2), 29), P3), 32)
    counts = ", ".join(f"sum(n * ((h >> {b}) & 1)) AS b{b}" for b in range(64))
    majority = " + ".join(f"(2 * b{b} > n)::UHUGEINT * {_n(1 << b)}" for b in range(64))
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (SELECT doc_id, array_to_string(list_slice(w, k, k + {SHINGLE_WORDS - 1}), ' ') AS g, count(*) AS n
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE_WORDS - 2}))) AS k FROM d WHERE len(w) > 0) GROUP BY ALL),
        raw AS (SELECT g, hex(encode(g)) AS x, octet_length(encode(g)) AS n FROM (SELECT DISTINCT g FROM shingles)),
        cut AS (SELECT g, n, n // 32 AS stripes, list_transform(range(0, n // 8), lambda k: {_lane("substr(x, 16 * k + 1, 16)")}) AS lanes,
            n % 8 >= 4 AS has_four, {_lane("substr(x, 16 * (n // 8) + 1, 8)")} AS four, list_transform(range(n - n % 4, n), lambda k: {_lane("substr(x, 2 * k + 1, 2)")}) AS ones FROM raw),
        striped AS (SELECT *, CASE WHEN stripes > 0 THEN list_transform([0, 1, 2, 3], lambda i: list_reduce(
            list_transform(range(0, stripes), lambda k: lanes[4 * k + i + 1]), lambda a, l: {_round("a", "l")}, ([{starts}]::UHUGEINT[])[i + 1])) END AS v FROM cut),
        begun AS (SELECT g, ones, has_four, four, lanes[4 * stripes + 1 :] AS rest,
            (n::UHUGEINT + CASE WHEN stripes > 0 THEN list_reduce(v, lambda a, l: {merged}, {whole}) ELSE {_n((SEED + P5) % WORD)} END) % {_n(WORD)} AS h FROM striped),
        eights AS (SELECT g, ones, has_four, four, list_reduce(rest, lambda a, l: {eight}, h) AS h FROM begun),
        bytes AS (SELECT g, list_reduce(ones, lambda a, l: {one}, CASE WHEN has_four THEN {four} ELSE h END) AS h FROM eights),
        hashed AS (SELECT g, ({last})::UBIGINT AS h FROM bytes),
        bits AS (SELECT doc_id, sum(n) AS n, {counts} FROM shingles JOIN hashed USING (g) GROUP BY 1),
        prints AS (SELECT doc_id, coalesce({majority}, 0)::UBIGINT AS fp FROM d LEFT JOIN bits USING (doc_id)),
        kinds AS (SELECT fp, min(doc_id) AS least, count(*) AS n FROM prints GROUP BY 1),
        near AS (SELECT a.fp AS a, b.fp AS b FROM kinds a JOIN kinds b ON bit_count(xor(a.fp, b.fp)) <= {RADIUS}),
        reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, near.b FROM r JOIN near ON r.b = near.a) SELECT * FROM r),
        whole AS (SELECT a AS fp, min(least) AS component_id, sum(n)::BIGINT AS component_size FROM reach JOIN kinds ON b = kinds.fp GROUP BY 1)
        SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id, component_size FROM prints JOIN whole USING (fp)
    """
