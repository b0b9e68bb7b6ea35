"""DuckDB SQL for the registered queries."""

from __future__ import annotations

DOCS = "SELECT doc_id AS ref_id, 'd' || doc_id AS name, text AS seq FROM documents"
PASSAGES = "SELECT item_id AS q_id, 'b' || item_id AS name, text AS seq FROM benchmark"
# passages and their reverse complements, for which the reverse strand must be found
BOTH_WAYS = "SELECT q_id * 2 AS q_id, name, seq FROM ({p}) UNION ALL SELECT q_id * 2 + 1, name || 'r', {rc} FROM ({p})"


def codes(x: str) -> str:
    return f"translate(regexp_replace(hex(encode({x})), '.(.)', '\\1', 'g'), '0123456789ABCDEF', '0011223300112233')"


def complement(c: str) -> str:
    return f"translate(reverse({c}), '0123', '2301')"


def revcomp(x: str) -> str:
    return f"translate({complement(codes(x))}, '0123', 'ACTG')"


def number(s: str, k: int, sigma: int = 4) -> str:
    """The k-mer code of a string of k code digits."""
    return "(" + " + ".join(f"(instr('0123456789abcdef', {s}[{i + 1}]) - 1) * {sigma ** (k - 1 - i)}" for i in range(k)) + ")"


def kmer_rows(source: str, key: str, k: int, coder=codes) -> str:
    """``key, pos, s`` for each k-mer, ``s`` its code digits."""
    return f"SELECT {key}, p.pos, substr(c, CAST(p.pos AS BIGINT) + 1, {k}) AS s FROM (SELECT {key}, {coder('seq')} AS c FROM ({source})), LATERAL (SELECT unnest(range(0, length(c) - {k} + 1)) AS pos) p"


def mapping(refs: str = DOCS, queries: str = PASSAGES, k: int = 15, bw: int = 15, pf: float = 0.1, both: bool = True, fragments: tuple[int, int] | None = None, select: str | None = None, coder=codes) -> str:
    """The mapping query; ``fragments`` is length and stride of fragments of k-mers."""
    if fragments:
        length, stride = fragments
        first = f"greatest(0, CASE WHEN pos >= {length} THEN (pos - {length}) // {stride} + 1 ELSE 0 END)"
        ix = f"SELECT ref_id, s, unnest(range({first}, pos // {stride} + 1)) AS pos FROM ({kmer_rows(refs, 'ref_id', k, coder)})"
        votes, unit = "SELECT q_id, fwd, ref_id, pos AS bin, j, pos, 0 AS sub FROM h", stride
    else:
        ix, unit = kmer_rows(refs, "ref_id", k, coder), bw
        votes = f"SELECT q_id, fwd, ref_id, b AS bin, j, pos, 0 AS sub FROM h UNION ALL SELECT q_id, fwd, ref_id, b - {bw}, j, pos, 1 FROM h WHERE b >= {bw}"
    reverse = f"UNION ALL SELECT q_id, false, {complement('c')} FROM q WHERE qlen > {2 * k}" if both else ""
    select = select or "q.q_id, q.name, q.qlen, coalesce(r.name, '*') AS ref, coalesce(fwd, true) AS fwd, coalesce(bin * {unit}, 0) AS pos, round(CAST(coalesce(support, 0) AS DOUBLE), 6) AS support"
    return f"""
        WITH r AS ({refs}), ix AS ({ix}),
        q AS (SELECT q_id, name, octet_length(encode(seq)) AS qlen, {coder('seq')} AS c FROM ({queries})),
        qs AS (SELECT q_id, true AS fwd, c FROM q WHERE qlen > {2 * k} {reverse}),
        qk AS (SELECT q_id, fwd, p.j, substr(c, CAST(p.j AS BIGINT) + 1, {k}) AS s FROM qs, LATERAL (SELECT unnest(range(0, length(c) - {k} + 1)) AS j) p),
        h AS (SELECT q_id, fwd, j, ref_id, pos, greatest(pos - j, 0) // {bw} AS b FROM qk JOIN ix USING (s)),
        v AS ({votes}),
        counted AS (SELECT q_id, fwd, ref_id, bin, count(*) AS cnt, max(row(j, ref_id, pos, sub)) AS last FROM v GROUP BY ALL),
        top AS (SELECT *, row_number() OVER (PARTITION BY q_id, fwd ORDER BY cnt DESC, last) AS place FROM counted WHERE cnt >= 2),
        sup AS (SELECT top.*, CAST((cnt - 1) / (qlen - {k} + 1) AS FLOAT) AS support FROM top JOIN q USING (q_id) WHERE place = 1),
        best AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY support DESC, fwd DESC) AS strand_place FROM sup WHERE support >= CAST({pf} AS FLOAT))
        SELECT {select.format(unit=unit)}
        FROM q LEFT JOIN best ON best.q_id = q.q_id AND strand_place = 1 LEFT JOIN r ON r.ref_id = best.ref_id
    """


SIGNALS = "SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x FROM events"


def _edges(edges: tuple[float, ...], x: str) -> str:
    return " + ".join(f"CAST({x} > CAST({e!r} AS DOUBLE) AS INTEGER)" for e in edges)


def dynamic(x: str) -> str:
    import numpy as np

    f = np.float32
    share, width = f(0.4), f(6)
    side = (f(1) - share) / f(2)
    a, b = (f(-2) - f(-3)) / width, (f(2) - f(-3)) / width
    d = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    place = f"(({x} + 3.0::DOUBLE) / 6.0::DOUBLE)"
    fine = f"{d(share)} * (({place} - {d(a)}) / {d(b - a)})"
    coarse = f"CASE WHEN {place} < 0.5 THEN {d(share)} + {d(side)} * {place} ELSE {d(share + side)} + {d(side)} * {place} END"
    return f"CAST(trunc((CASE WHEN {x} >= -2 AND {x} <= 2 THEN {fine} ELSE {coarse} END) * 15) AS INTEGER) & 15"


def xxh64(x: str, seed: int = 42) -> str:
    """XXH64 of the eight bytes of a number from 0, as a signed number; products and sums are taken modulo 2^64."""
    # The first to fifth prime of the hash.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    mod = "18446744073709551616::UHUGEINT"
    wrap = lambda e: f"CAST(({e}) % {mod} AS UBIGINT)"
    times = lambda a, b: wrap(f"CAST({a} AS UHUGEINT) * {b}::UHUGEINT")
    plus = lambda a, b: wrap(f"CAST({a} AS UHUGEINT) + {b}::UHUGEINT")
    rotated = lambda a, n: f"CAST(({times(a, 1 << n)} | (({a}) >> {64 - n})) AS UBIGINT)"
    steps = [
        ("k", times(rotated("a", 31), p1), times(x, p2)),
        ("h", plus(times(rotated("a", 27), p1), p4), f"xor({(seed + p5 + 8) % 2**64}::UBIGINT, k)"),
        ("h2", times("a", p2), "xor(h, h >> 33)"),
        ("h3", times("a", p3), "xor(h2, h2 >> 29)"),
        ("h4", "xor(a, a >> 32)", "h3"),
    ]
    out = "CASE WHEN h4 >= 9223372036854775808::UBIGINT THEN CAST(CAST(h4 AS HUGEINT) - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(h4 AS BIGINT) END"
    for name, value, of in reversed(steps):
        out = f"(SELECT {out} FROM (SELECT {value} AS {name} FROM (SELECT {of} AS a)))"
    return out


def statistic(w: int) -> str:
    """The windowed t-statistic of ``z`` in order of ``p``, windows ``l`` and ``r`` of that width."""
    l, r = f"l{w}", f"r{w}"  # noqa: E741
    spread = f"(avg(z * z) OVER {l} - avg(z) OVER {l} * avg(z) OVER {l} + avg(z * z) OVER {r} - avg(z) OVER {r} * avg(z) OVER {r}) / {w}"
    return f"CASE WHEN p >= {w} AND p <= n - {w} THEN abs(avg(z) OVER {r} - avg(z) OVER {l}) / sqrt(greatest({spread}, 2.220446049250313e-16)) ELSE 0 END"


def detector(a: str, t: str, half: int, threshold: float) -> dict[str, str]:
    """Columns of one peak detector behind one more value ``t`` at place ``s.p``; ``a`` is the state before, by column."""
    peak, high, top = "CAST(0.4000000059604645 AS DOUBLE)", f"greatest({a}val, {t})", f"CASE WHEN {t} > {a}val THEN s.p ELSE {a}top END"
    over = f"({a}over OR {high} > {threshold})"
    fallen = f"({a}fallen OR {high} > {threshold} AND {high} - {t} > {peak})"
    closed = f"({a}top IS NOT NULL AND {fallen} AND s.p - ({top}) > {half})"
    rise = f"({a}top IS NULL AND {t} - {a}low > {peak})"
    return {
        "low": f"CASE WHEN {closed} THEN {t} WHEN {a}top IS NULL AND NOT {rise} THEN least({a}low, {t}) ELSE {a}low END",
        "top": f"CASE WHEN {closed} THEN NULL WHEN {rise} THEN s.p WHEN {a}top IS NULL THEN NULL ELSE {top} END",
        "val": f"CASE WHEN {rise} THEN {t} WHEN {a}top IS NULL OR {closed} THEN 0 ELSE {high} END",
        "over": f"{a}top IS NOT NULL AND NOT {closed} AND {over}",
        "fallen": f"{a}top IS NOT NULL AND NOT {closed} AND {fallen}",
        "out": f"CASE WHEN {closed} THEN {top} END",
    }


def segment_events(z: str) -> str:
    """Both detectors as a walk over each signal, sample by sample; the long window's one starts anew behind the other's."""
    fine, wide = detector("f_", "s.t3", 1, 4.0), detector("g_", "g.t9", 4, 3.5)
    new = "'infinity'::DOUBLE AS {0}low, NULL::BIGINT AS {0}top, 0::DOUBLE AS {0}val, false AS {0}over, false AS {0}fallen, NULL::BIGINT AS {0}out"
    frame = "l{0} AS (PARTITION BY read_id ORDER BY p ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING), r{0} AS (PARTITION BY read_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {1} FOLLOWING)"
    first = "CASE WHEN s.f_over OR s.f_out IS NOT NULL THEN {1} ELSE s.g_{0} END AS g_{0}"
    begun = ", ".join(first.format(c, v) for c, v in (("low", "'infinity'::DOUBLE"), ("top", "NULL"), ("val", "0"), ("over", "false"), ("fallen", "false")))
    seen = "NOT g.f_over AND g.p >= g.free"
    return f"""
        WITH RECURSIVE k AS MATERIALIZED (
          SELECT read_id, z, row_number() OVER (PARTITION BY read_id ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY read_id) AS n FROM ({z}) WHERE z < 3 AND z > -3
        ),
        t AS MATERIALIZED (SELECT read_id, p, n, {statistic(3)} AS t3, {statistic(9)} AS t9 FROM k WINDOW {frame.format(3, 2)}, {frame.format(9, 8)}),
        walk AS (
          SELECT read_id, 0::BIGINT AS p, 1::BIGINT AS free, {new.format("f_")}, {new.format("g_")} FROM t WHERE p = 0
          UNION ALL
          SELECT g.read_id, g.p, g.free, {", ".join(f"g.f_{c}" for c in fine)}, {", ".join(f"CASE WHEN {seen} THEN {e.replace('s.p', 'g.p')} ELSE {'NULL' if c == 'out' else 'g.g_' + c} END" for c, e in wide.items())}
          FROM (
            SELECT s.* EXCLUDE (free, g_low, g_top, g_val, g_over, g_fallen), CASE WHEN s.f_out IS NULL THEN s.free ELSE greatest(s.p, s.f_out + 4) END AS free, {begun}
            FROM (
              SELECT w.read_id, s.p, w.free AS free, s.t9, {", ".join(f"{e.replace('f_', 'w.f_')} AS f_{c}" for c, e in fine.items())}, w.g_low, w.g_top, w.g_val, w.g_over, w.g_fallen
              FROM walk w JOIN t s ON s.read_id = w.read_id AND s.p = w.p + 1
            ) s
          ) g
        ),
        border AS (SELECT read_id, f_out AS b FROM walk WHERE f_out IS NOT NULL UNION SELECT read_id, g_out FROM walk WHERE g_out IS NOT NULL),
        placed AS (SELECT read_id, z, (SELECT count(*) FROM border x WHERE x.read_id = k.read_id AND x.b <= k.p) AS event, (SELECT count(*) FROM border x WHERE x.read_id = k.read_id) AS total FROM k),
        o AS (SELECT read_id, event, z, row_number() OVER (PARTITION BY read_id, event ORDER BY z) - 1 AS place, count(*) OVER (PARTITION BY read_id, event) AS m FROM placed WHERE event < total),
        q AS (SELECT read_id, event, max(z) FILTER (place = m // 4) AS q1, max(z) FILTER (place = 3 * m // 4) AS q3 FROM o GROUP BY ALL)
        SELECT read_id, event, round(avg(z), 6) AS mean FROM o JOIN q USING (read_id, event) WHERE z >= q1 - (q3 - q1) AND z <= q3 + (q3 - q1) GROUP BY ALL
    """


def all_sql(edges_16: tuple[float, ...], edges_8: tuple[float, ...]) -> dict[str, str]:
    item = "SELECT item_id AS ref_id, text AS seq FROM benchmark"
    z = f"SELECT read_id, i, (x - avg(x) OVER w) / sqrt(avg(x * x) OVER w - avg(x) OVER w * avg(x) OVER w) AS z FROM ({SIGNALS}) WINDOW w AS (PARTITION BY read_id)"
    scaled = "SELECT vec_id AS read_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) * 8 AS x FROM embeddings"
    best = f"SELECT q_id FROM ({mapping()}) WHERE ref <> '*'"
    both_ways = BOTH_WAYS.format(p=PASSAGES, rc=revcomp("seq"))
    fr_refs = f"SELECT ref_id * 2 AS ref_id, name || '+' AS name, seq FROM ({DOCS}) UNION ALL SELECT ref_id * 2 + 1, name || '-', {revcomp('seq')} FROM ({DOCS})"
    tstat = f"""
        WITH s AS ({SIGNALS}),
        m AS (SELECT read_id, i, count(*) OVER (PARTITION BY read_id) AS n, avg(x) OVER l AS m1, avg(x) OVER r AS m2, avg(x * x) OVER l AS s1, avg(x * x) OVER r AS s2 FROM s
              WINDOW l AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
        SELECT read_id, i, round(CASE WHEN i >= 3 AND i <= n - 3 THEN abs(m2 - m1) / sqrt(greatest((s1 - m1 * m1 + s2 - m2 * m2) / 3, 2.220446049250313e-16)) ELSE 0 END, 4) AS t FROM m
    """
    band = f"""
        WITH RECURSIVE s AS ({SIGNALS}), walk AS (
          SELECT read_id, i, x AS last, true AS kept FROM s WHERE i = 0
          UNION ALL
          SELECT s.read_id, s.i, CASE WHEN abs(s.x - w.last) >= CAST(0.3499999940395355 AS DOUBLE) THEN s.x ELSE w.last END, abs(s.x - w.last) >= CAST(0.3499999940395355 AS DOUBLE)
          FROM walk w JOIN s ON s.read_id = w.read_id AND s.i = w.i + 1
        )
        SELECT read_id, i, {dynamic('last')} AS code FROM walk WHERE kept
    """
    events = segment_events(z)
    levels = f"SELECT vec_id, i, {_edges(edges_16, 'x')} AS level FROM (SELECT read_id AS vec_id, i, x FROM ({scaled}))"
    quantised = f"SELECT vec_id AS ref_id, 'v' || vec_id AS name, string_agg(substr('0123456789abcdef', level + 1, 1), '' ORDER BY i) AS seq FROM ({levels}) GROUP BY vec_id"
    same = lambda x: x
    n_frags = f"SELECT ref_id, name, CAST(ceil(greatest(octet_length(encode(seq)) - 14, 0) / 60) AS INTEGER) AS n_frags FROM ({DOCS})"
    fragment_table = f"""
        SELECT ref_id, name, row_number() OVER (ORDER BY ref_id) - 1 AS ordinal, CAST(coalesce(sum(n_frags) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frag_start, n_frags FROM ({n_frags})"""
    return {
        "encode_bytes": f"SELECT item_id, {codes('text')} AS codes FROM benchmark",
        "revcomp": f"SELECT doc_id, md5({revcomp('text')}) AS revcomp_md5 FROM documents",
        "kmer_extract": f"SELECT ref_id AS item_id, pos, {number('s', 15)} AS kmer FROM ({kmer_rows(item, 'ref_id', 15)})",
        "kmer_sql_equal": "SELECT item_id, true AS equal FROM benchmark",
        "pack_posting": f"SELECT ref_id AS doc_id, count(*) AS n, CAST(sum(((ref_id << 44) | pos) % 1000003) AS BIGINT) AS packed, CAST(sum(pos) AS BIGINT) AS places FROM ({kmer_rows(DOCS, 'ref_id', 15)}) GROUP BY ref_id",
        "shard_key": f"""
            SELECT ref_id AS doc_id, count(*) AS n, CAST(sum((kmer & 1023) * (pos % 1009)) AS BIGINT) AS shards, CAST(sum((kmer >> 10) * (pos % 1009)) AS BIGINT) AS skeys
            FROM (SELECT ref_id, pos, {number('s', 15)} AS kmer FROM ({kmer_rows(DOCS, 'ref_id', 15)})) GROUP BY ref_id""",
        "index_histogram": f"SELECT {number('s', 8)} AS kmer, n FROM (SELECT s, count(*) AS n FROM ({kmer_rows(DOCS, 'ref_id', 8)}) GROUP BY s)",
        "index_offsets": f"SELECT kmer, n, CAST(coalesce(sum(n) OVER (ORDER BY kmer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT {number('s', 8)} AS kmer, n FROM (SELECT s, count(*) AS n FROM ({kmer_rows(DOCS, 'ref_id', 8)}) GROUP BY s))",
        "occ_profile": f"""
            WITH c AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS place, count(*) OVER () AS total FROM (SELECT count(*) AS n FROM ({kmer_rows(DOCS, 'ref_id', 15)}) GROUP BY s))
            SELECT min(n) AS min_occ, max(n) FILTER (place = total // 2) AS median_occ, max(n) FILTER (place = total * 99 // 100) AS p99_occ, max(n) AS max_occ FROM c""",
        "minimizers": f"""
            WITH m AS (SELECT ref_id, pos, {number('s', 10)} AS kmer, max(pos) OVER (PARTITION BY ref_id) AS last FROM ({kmer_rows(DOCS, 'ref_id', 10)})),
            c AS (SELECT ref_id, pos AS place, last, min(row(kmer, pos)) OVER (PARTITION BY ref_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS least FROM m),
            d AS (SELECT ref_id, place, least[2] AS pos FROM c WHERE place + 4 <= last),
            e AS (SELECT ref_id, pos, lag(pos) OVER (PARTITION BY ref_id ORDER BY place) AS before FROM d)
            SELECT ref_id AS doc_id, count(*) AS n, CAST(sum(pos * (pos % 1009)) AS BIGINT) AS places FROM e WHERE before IS NULL OR before <> pos GROUP BY ref_id""",
        "run_offsets": f"""
            WITH k AS ({kmer_rows(DOCS, 'ref_id', 1)}), l AS (SELECT ref_id, pos, s, lag(s) OVER (PARTITION BY ref_id ORDER BY pos) AS before FROM k),
            b AS (SELECT ref_id, pos AS start FROM l WHERE before IS NULL OR before <> s UNION ALL SELECT ref_id, count(*) FROM k GROUP BY ref_id)
,
            r AS (SELECT ref_id, row_number() OVER (PARTITION BY ref_id ORDER BY start) - 1 AS run, start FROM b)
            SELECT ref_id AS doc_id, count(*) AS n, CAST(sum(start * (run % 1009 + 1)) AS BIGINT) AS starts FROM r GROUP BY ref_id""",
        "map_coordinate": mapping(),
        "map_saved_index": mapping(),
        "map_both_strands": mapping(queries=both_ways),
        "map_coordinate_fr": mapping(refs=fr_refs, queries=both_ways, both=False),
        "map_fragment": mapping(fragments=(180, 60)),
        "map_fragment_compressed": mapping(fragments=(180, 60)),
        "map_fragment_compat": f"""
            WITH t AS ({fragment_table}), b AS ({mapping(fragments=(180, 60), select="q.q_id, q.name, q.qlen, best.ref_id, fwd, bin, support")}),
            p AS (SELECT b.*, frag_start, ordinal + CAST(bin <> 0 AS INTEGER) AS place FROM b LEFT JOIN t ON t.ref_id = b.ref_id)
            SELECT q_id, p.name, qlen, coalesce(m.name, '*') AS ref, m.name IS NULL OR fwd AS fwd, CASE WHEN m.name IS NULL THEN 0 ELSE (p.frag_start + bin - place) * 60 END AS pos,
                   CASE WHEN m.name IS NULL THEN 0.0::DOUBLE ELSE round(CAST(support AS DOUBLE), 6) END AS support
            FROM p LEFT JOIN t m ON m.ordinal + 1 = place""",
        "fragment_table": fragment_table,
        "ipow": "SELECT p_partkey, CAST(power(3, p_partkey % 33) AS BIGINT) AS power FROM part",
        "split64": "SELECT o_orderkey, (CAST(o_orderkey AS BIGINT) << 32) | o_custkey AS packed, o_orderkey AS high, o_custkey AS low FROM orders",
        "picoamps": "SELECT event_id, round((value + 10) * (1400.0::DOUBLE / 8192.0::DOUBLE), 6) AS pa FROM events",
        "trimmed_means": f"""
            WITH s AS (SELECT read_id, i // 12 AS segment, x, row_number() OVER (PARTITION BY read_id, i // 12 ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY read_id, i // 12) AS n FROM ({SIGNALS})),
            q AS (SELECT read_id, segment, max(x) FILTER (place = n // 4) AS q1, max(x) FILTER (place = 3 * n // 4) AS q3 FROM s GROUP BY ALL)
            SELECT read_id, segment, round(avg(x), 6) AS mean FROM s JOIN q USING (read_id, segment) WHERE x >= q1 - (q3 - q1) AND x <= q3 + (q3 - q1) GROUP BY ALL""",
        "signal_kmers": f"SELECT ref_id AS read_id, pos, {number('s', 6, 16)} AS kmer FROM ({kmer_rows(quantised, 'ref_id', 6, same)})",
        "map_signal": mapping(quantised, f"SELECT ref_id AS q_id, name, substr(seq, 11) AS seq FROM ({quantised})", k=6, bw=5, both=False, coder=same),
        "guard_short": "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) > 30",
        "support_threshold": f"SELECT q_id, ref, fwd, pos, support FROM ({mapping(pf=0.6)}) WHERE ref <> '*'",
        "strand_choice": f"SELECT fwd, count(*) AS n FROM ({mapping(queries=both_ways)}) GROUP BY fwd",
        "dyn_two_batches": mapping(),
        "tsv_sink": f"SELECT q_id, concat_ws(chr(9), name, qlen, ref, CASE WHEN fwd THEN '+' ELSE '-' END, pos, printf('%.6f', support)) AS line FROM ({mapping()})",
        "alignments": f"SELECT q_id, ref AS ctg, CAST(pos AS INTEGER) AS r_st, CAST(pos + qlen AS INTEGER) AS r_en, CASE WHEN fwd THEN 1 ELSE -1 END AS strand, support AS pres_frac FROM ({mapping()})",
        "map_reads": f"SELECT item_id, CASE WHEN item_id IN ({best}) THEN 1 ELSE 0 END AS n_alignments FROM benchmark",
        "stream_reads": f"""
            SELECT q_id AS request, nullif(ref, '*') AS ctg, CASE WHEN ref <> '*' THEN CAST(pos AS INTEGER) END AS r_st, CASE WHEN ref = '*' THEN NULL WHEN fwd THEN 1 ELSE -1 END AS strand
            FROM ({mapping()})""",
        "xxh64": f"SELECT item_id, {xxh64('CAST(item_id AS BIGINT)')} AS hash FROM benchmark",
        "signal_normalise": f"SELECT read_id, i, round(z, 4) AS z FROM ({z}) WHERE z < 3 AND z > -3",
        "signal_tstat": tstat,
        "quantise_static16": f"SELECT read_id, i, {_edges(edges_16, 'x')} AS level FROM ({scaled})",
        "quantise_static8": f"SELECT read_id, i, {_edges(edges_8, 'x')} AS level FROM ({scaled})",
        "quantise_dynamic": f"SELECT read_id, i, {dynamic('x')} AS code FROM ({scaled})",
        "quantise_deadband": f"SELECT read_id, count(*) AS n, CAST(sum(code) AS BIGINT) AS code_sum FROM ({band}) GROUP BY read_id",
        "segment_events": events,
        "squiggle": f"""
            WITH m AS (SELECT range AS code, CAST(range * 7919 % 4096 AS DOUBLE) AS level FROM range(4096)), s AS (SELECT code, (level - (SELECT avg(level) FROM m)) / (SELECT stddev_pop(level) FROM m) AS level FROM m)
            SELECT ref_id AS doc_id, count(*) AS n, CAST(sum(CAST(round(level * 1000000) AS BIGINT) * (pos % 1009)) AS BIGINT) AS level_sum
            FROM (SELECT ref_id, pos, {number('s', 6)} AS kmer FROM ({kmer_rows(DOCS, 'ref_id', 6)})) JOIN s ON code = kmer GROUP BY ref_id""",
    }
