"""DuckDB SQL with the results of the queries, where SQL can say them."""

from __future__ import annotations

WORLDS, SEED, CENTERS, ALGORITHM_SEED = 46, 42, 5, 1

GRAPH = """
    pick AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem WHERE l_quantity >= 48),
    edges AS (
        SELECT a.s AS src, b.s AS dst, count(*) AS cnt, 1 - exp(-0.5 * count(*)) AS probability
        FROM pick a JOIN pick b ON a.o = b.o AND a.s < b.s GROUP BY a.s, b.s
    ),
    vertices AS (SELECT src AS vertex FROM edges UNION SELECT dst FROM edges),
    arcs AS (SELECT src AS a, dst AS b, cnt, probability FROM edges UNION ALL SELECT dst, src, cnt, probability FROM edges)
"""
COIN = "('0x' || substr(md5(concat_ws('|', {key})), 1, 13))::BIGINT"

def alive(worlds: int) -> str:
    """Edges of the first worlds, and their arcs."""
    return f"""
    alive AS (
        SELECT w.world, src, dst FROM edges, range({worlds}) w(world)
        WHERE {COIN.format(key=f"{SEED}, w.world, src, dst")} / 4503599627370496.0 <= probability
    ),
    steps AS MATERIALIZED (SELECT world, src AS a, dst AS b FROM alive UNION ALL SELECT world, dst, src FROM alive)
"""


def components(worlds: int) -> str:
    return f"""
    reach AS (
        SELECT w.world, vertex, vertex AS root FROM vertices, range({worlds}) w(world)
        UNION SELECT r.world, s.b, r.root FROM reach r JOIN steps s ON s.world = r.world AND s.a = r.vertex
    ),
    components AS MATERIALIZED (SELECT world, vertex, min(root) AS comp FROM reach GROUP BY world, vertex)
"""


ALIVE, COMPONENTS = alive(WORLDS), components(WORLDS)
FIXED = f"""
    firsts AS (SELECT vertex AS center FROM vertices ORDER BY vertex LIMIT {CENTERS}),
    hits AS (
        SELECT o.vertex, f.center, count(*) / {WORLDS} AS probability
        FROM firsts f JOIN components c ON c.vertex = f.center JOIN components o ON o.world = c.world AND o.comp = c.comp GROUP BY ALL
    ),
    best AS (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY probability DESC, center) AS nth FROM hits),
    fixed AS MATERIALIZED (
        SELECT v.vertex, coalesce(b.center, (SELECT min(vertex) FROM vertices)) AS center, coalesce(b.vertex = b.center, false) AS is_center, coalesce(b.probability, 0) AS probability
        FROM vertices v LEFT JOIN best b ON b.vertex = v.vertex AND b.nth = 1
    )
"""
WITH_GRAPH = f"WITH RECURSIVE {GRAPH}"
WITH_ALIVE = f"{WITH_GRAPH}, {ALIVE}"
WITH_COMPONENTS = f"{WITH_ALIVE}, {COMPONENTS}"
WITH_FIXED = f"{WITH_COMPONENTS}, {FIXED}"

LINES = f"""{WITH_GRAPH},
    lines AS (
        SELECT (src * 100000 + dst) * 4 AS line_no, 's' || src AS a, 's' || dst AS b,
               CASE WHEN dst % 10 = 0 THEN 1.0::DOUBLE ELSE printf('%.6f', probability)::FLOAT::DOUBLE END AS probability FROM edges
        UNION ALL SELECT (src * 100000 + dst) * 4 + 1, 's' || dst, 's' || src, 0.5 FROM edges WHERE src % 3 = 0
    ),
    names AS (SELECT a AS label, line_no, 0 AS pos FROM lines UNION ALL SELECT b, line_no, 1 FROM lines),
    firsts AS (SELECT label, min((line_no, pos)) AS place FROM names GROUP BY label),
    dictionary AS (SELECT row_number() OVER (ORDER BY place) - 1 AS vertex, label FROM firsts)
"""
REACHED = """
    linked AS (SELECT vertex AS v, vertex AS root FROM vertices UNION SELECT a.b, l.root FROM linked l JOIN arcs a ON a.a = l.v),
    static AS (SELECT v AS vertex, min(root) AS comp FROM linked GROUP BY v)
"""
RUNS = """
    line AS (
        SELECT l_returnflag, l_linestatus, month(l_shipdate) AS month, avg(l_discount) AS p_min, avg(l_tax) AS p_avg, count(*)::DOUBLE AS time
        FROM lineitem GROUP BY ALL
    ),
    runs AS (
        SELECT concat_ws('-', l_returnflag, l_linestatus, month) AS run,
               CASE l_returnflag WHEN 'A' THEN 'k-center' WHEN 'N' THEN 'k-median' ELSE 'gmm' END AS algorithm,
               CASE l_linestatus WHEN 'F' THEN 'data/collins-lcc.txt' ELSE 'data/dblp-vldb.lcc.txt' END AS input,
               (month % 4 + 2)::BIGINT AS k, p_min, p_avg, time
        FROM line
    )
"""


def depth(d: int) -> str:
    """Paths of at most ``d`` edges, unrolled."""
    seen = f"seen0 AS (SELECT w.world, min(vertex) AS v FROM vertices, range({WORLDS}) w(world) GROUP BY w.world)"
    for k in range(1, d + 1):
        seen += f", seen{k} AS (SELECT * FROM seen{k - 1} UNION SELECT s.world, t.b FROM seen{k - 1} s JOIN steps t ON t.world = s.world AND t.a = s.v)"
    return f"{WITH_ALIVE}, {seen} SELECT v.vertex, round(count(s.world) / {WORLDS}, 9) AS probability FROM vertices v LEFT JOIN seen{d} s ON s.v = v.vertex GROUP BY v.vertex"


#: The guesses of a search by halves, and the worlds each asks for; the SQL fails where none of them is valid.
GUESSES = ((1.0, 46), (0.5, 92), (0.25005, 184))
MET = "SELECT c.vertex AS center, o.vertex, count(*) / {r} AS probability FROM components c JOIN components o ON o.world = c.world AND o.comp = c.comp WHERE c.world < {r} GROUP BY ALL HAVING count(*) / {r} >= {p}"
MET_IN_4 = "SELECT root AS center, v AS vertex, count(*) / {r} AS probability FROM seen4 WHERE world < {r} GROUP BY ALL HAVING count(*) / {r} >= {p}"


def guess(g: int, p: float, r: int, k: int, allowed: int, met: str = MET, batch: int | None = None) -> str:
    """The clustering ``found{g}`` and ``done{g}`` of one guess, with the picks of centers unrolled, one step each."""
    prio = lambda round_: COIN.format(key=f"'priority', {ALGORITHM_SEED}, {round_}, vertex")
    sql = f"""
        order{g} AS MATERIALIZED (SELECT vertex, {prio(g)} AS prio FROM vertices),
        near{g} AS MATERIALIZED ({met.format(r=r, p=p)}),
        open{g}_0 AS (SELECT vertex FROM vertices)"""
    picks = []
    for c in range(1, k):
        if batch is None:
            pick = f"SELECT {c} AS nth, vertex AS center FROM order{g} WHERE vertex IN (SELECT vertex FROM open{g}_{c - 1}) ORDER BY prio, vertex LIMIT 1"
        else:
            pick = f"""SELECT {c} AS nth, d.vertex AS center
                FROM (SELECT vertex, {prio(g * 1_000_003 + c)} AS prio FROM open{g}_{c - 1} ORDER BY prio, vertex LIMIT {batch}) d
                ORDER BY (SELECT count(*) FROM near{g} n WHERE n.center = d.vertex AND n.vertex IN (SELECT vertex FROM open{g}_{c - 1})) DESC, prio, d.vertex LIMIT 1"""
        sql += f""",
        pick{g}_{c} AS MATERIALIZED ({pick}),
        open{g}_{c} AS MATERIALIZED (SELECT vertex FROM open{g}_{c - 1} WHERE vertex NOT IN (SELECT vertex FROM near{g} JOIN pick{g}_{c} USING (center)))"""
        picks.append(f"SELECT nth, center, (SELECT count(*) FROM open{g}_{c}) AS uncovered FROM pick{g}_{c}")
    return f"""{sql},
        picks{g} AS MATERIALIZED ({" UNION ALL ".join(picks)}),
        done{g} AS MATERIALIZED (SELECT min(nth) AS done FROM picks{g} WHERE nth + uncovered <= {allowed}),
        covers{g} AS (
            SELECT n.*, row_number() OVER (PARTITION BY vertex ORDER BY probability DESC, nth) AS best
            FROM near{g} n JOIN picks{g} USING (center) WHERE nth <= coalesce((SELECT done FROM done{g}), {k})
        ),
        found{g} AS MATERIALIZED (
            SELECT {g} AS guess, v.vertex, CASE WHEN c.center IS NULL AND done IS NOT NULL THEN v.vertex ELSE c.center END AS center,
                   coalesce(v.vertex = c.center, done IS NOT NULL) AS is_center,
                   CASE WHEN c.center IS NULL AND done IS NOT NULL THEN 1 ELSE c.probability END AS probability
            FROM vertices v LEFT JOIN covers{g} c ON c.vertex = v.vertex AND c.best = 1, done{g}
        )"""


def greedy(p: float, k: int, allowed: int) -> str:
    return f"{WITH_COMPONENTS}, {guess(0, p, WORLDS, k, allowed)} SELECT vertex, center, is_center, round(probability, 9) AS probability FROM found0"


def searched(k: int, met: str = MET, batch: int | None = None) -> str:
    """All guesses, and ``first_valid``, the number of the first valid one."""
    worlds = GUESSES[-1][1]
    if met == MET:
        sql = f"{WITH_GRAPH}, {alive(worlds)}, {components(worlds)}"
    else:
        sql = f"{WITH_GRAPH}, {alive(worlds)}, seen0 AS (SELECT w.world, vertex AS root, vertex AS v FROM vertices, range({worlds}) w(world))"
        for d in range(1, 5):
            sql += f", seen{d} AS MATERIALIZED (SELECT * FROM seen{d - 1} UNION SELECT s.world, s.root, t.b FROM seen{d - 1} s JOIN steps t ON t.world = s.world AND t.a = s.v)"
    sql += "".join(f", {guess(g, p, r, k, k, met, batch)}" for g, (p, r) in enumerate(GUESSES))
    valid = "CASE" + "".join(f" WHEN (SELECT done FROM done{g}) IS NOT NULL THEN {g}" for g in range(len(GUESSES)))
    return f"{sql}, first_valid AS MATERIALIZED (SELECT {valid} ELSE error('no valid guess')::INTEGER END AS g), every AS ({' UNION ALL '.join(f'FROM found{g}' for g in range(len(GUESSES)))})"


def minimum(k: int, met: str = MET) -> str:
    """The first valid guess."""
    return f"{searched(k, met)} SELECT vertex, center, is_center, round(probability, 9) AS probability FROM every WHERE guess = (SELECT g FROM first_valid)"


def average(k: int, batch: int | None = None) -> str:
    """Of the guesses made, that with the largest sum; who it leaves out joins the center it meets most in the last guess's worlds."""
    last = "CASE (SELECT g FROM first_valid)" + "".join(f" WHEN {g} THEN {r}" for g, (_, r) in enumerate(GUESSES)) + " END"
    return f"""{searched(k, batch=batch)},
        best AS MATERIALIZED (SELECT guess FROM every WHERE guess <= (SELECT g FROM first_valid) GROUP BY guess ORDER BY coalesce(sum(probability), 0) DESC, guess LIMIT 1),
        chosen AS MATERIALIZED (FROM every WHERE guess = (SELECT guess FROM best)),
        met AS (
            SELECT m.vertex, c.vertex AS center, count(*) AS hits FROM chosen m JOIN components a ON a.vertex = m.vertex AND a.world < {last}
            JOIN components b ON b.world = a.world AND b.comp = a.comp JOIN chosen c ON c.vertex = b.vertex AND c.is_center WHERE m.center IS NULL GROUP BY ALL
        ),
        top AS (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY hits DESC, center) AS nth FROM met)
        SELECT c.vertex, coalesce(c.center, t.center) AS center, is_center, round(coalesce(probability, hits / {last}, 0), 9) AS probability
        FROM chosen c LEFT JOIN top t ON t.vertex = c.vertex AND t.nth = 1"""


def farthest(k: int = 3, worlds: int = 460, rounds: int = 14) -> str:
    """Farthest-first centers, each with the relaxation of all edges unrolled, then connections with the own center."""
    first = f"SELECT vertex FROM vertices ORDER BY {COIN.format(key=f"'priority', {ALGORITHM_SEED}, 0, vertex")}, vertex LIMIT 1"
    sql = f"{WITH_GRAPH}, {alive(worlds)}, center0 AS MATERIALIZED ({first})"
    for c in range(k):
        sql += f", d{c}_0 AS (SELECT vertex, 0.0::DOUBLE AS distance FROM center{c})"
        for n in range(1, rounds + 1):
            sql += f""", d{c}_{n} AS MATERIALIZED (
                SELECT vertex, min(distance) AS distance FROM (
                    SELECT * FROM d{c}_{n - 1} UNION ALL SELECT a.b, d.distance - ln(a.probability) FROM d{c}_{n - 1} d JOIN arcs a ON a.a = d.vertex
                ) GROUP BY vertex)"""
        reached = f"SELECT v.vertex, (SELECT vertex FROM center{c}) AS center, coalesce(d.distance, 'inf'::DOUBLE) AS distance FROM vertices v LEFT JOIN d{c}_{rounds} d USING (vertex)"
        if c:
            reached = f"SELECT o.vertex, CASE WHEN n.distance < o.distance THEN n.center ELSE o.center END AS center, least(n.distance, o.distance) AS distance FROM state{c - 1} o JOIN ({reached}) n USING (vertex)"
        sql += f", state{c} AS MATERIALIZED ({reached}), center{c + 1} AS MATERIALIZED (SELECT vertex FROM state{c} ORDER BY distance DESC, vertex LIMIT 1)"
    return f"""{sql},
        own AS (SELECT DISTINCT center FROM state{k - 1}),
        reach AS (SELECT w.world, center AS vertex, center AS root FROM own, range({worlds}) w(world)
                  UNION SELECT r.world, s.b, r.root FROM reach r JOIN steps s ON s.world = r.world AND s.a = r.vertex)
        SELECT s.vertex, s.center, s.vertex = s.center AS is_center, round(count(r.world) / {worlds}, 9) AS probability
        FROM state{k - 1} s LEFT JOIN reach r ON r.vertex = s.vertex AND r.root = s.center GROUP BY ALL"""


def flow(rounds: int = 40) -> str:
    """Markov clustering, one step after the other."""
    sql = f"""{WITH_GRAPH},
        start AS (SELECT a AS i, b AS j, probability AS v FROM arcs UNION ALL SELECT b, b, max(probability) FROM arcs GROUP BY b),
        m0 AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM start)"""
    for n in range(1, rounds + 1):
        sql += f""",
        s{n} AS (SELECT l.i, r.j, sum(l.v * r.v) AS v FROM m{n - 1} l JOIN m{n - 1} r ON l.j = r.i GROUP BY l.i, r.j),
        m{n} AS MATERIALIZED (SELECT i, j, v * v / sum(v * v) OVER (PARTITION BY j) AS v FROM s{n} WHERE v >= 1e-3)"""
    return f"{sql} SELECT j AS vertex, arg_max(i, (round(v, 6), -i)) AS center FROM m{rounds} GROUP BY j"


def shortest(rounds: int = 14) -> str:
    """Relaxation of all edges, unrolled."""
    sql = f"{WITH_GRAPH}, d0 AS (SELECT vertex AS source, vertex, 0.0::DOUBLE AS distance FROM (SELECT vertex FROM vertices ORDER BY vertex LIMIT 2))"
    for k in range(1, rounds + 1):
        sql += f""", d{k} AS MATERIALIZED (
            SELECT source, vertex, min(distance) AS distance FROM (
                SELECT * FROM d{k - 1} UNION ALL SELECT d.source, a.b, d.distance - ln(a.probability) FROM d{k - 1} d JOIN arcs a ON a.a = d.vertex
            ) GROUP BY source, vertex)"""
    return f"{sql} SELECT source, vertex, round(distance, 9) AS distance FROM d{rounds}"


CONFUSION = """
    SELECT {keys} tp, fp, pairs - tp AS fn, n * (n - 1) // 2 - pairs - fp AS tn,
           round(tp / nullif(pairs, 0), 9) AS tpr, round(fp / nullif(n * (n - 1) // 2 - pairs, 0), 9) AS fpr,
           round((pairs - tp) / nullif(pairs, 0), 9) AS fnr, round((n * (n - 1) // 2 - pairs - fp) / nullif(n * (n - 1) // 2 - pairs, 0), 9) AS tnr
    FROM counts, (SELECT count(*) AS pairs FROM wanted), (SELECT count(*) AS n FROM supplier)
"""
WANTED = "wanted AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"

ORACLE: dict[str, str] = {
    "edge_cooccurrence": f"{WITH_GRAPH} SELECT src, dst, cnt FROM edges",
    "edge_probability": f"{WITH_GRAPH} SELECT src, dst, round(probability, 9) AS probability, round(-ln(probability), 9) AS weight FROM edges",
    "edge_text_parse": f"""{LINES}, kept AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY line_no) AS nth FROM lines)
        SELECT row_number() OVER (ORDER BY line_no) - 1 AS edge_id, s.vertex AS src, d.vertex AS dst, round(probability, 9) AS probability
        FROM kept JOIN dictionary s ON s.label = a JOIN dictionary d ON d.label = b WHERE nth = 1""",
    "vertex_dictionary": f"{LINES} SELECT vertex, label FROM dictionary",
    "static_components": f"{WITH_GRAPH}, {REACHED} SELECT * FROM static",
    "component_sizes": f"{WITH_GRAPH}, {REACHED} SELECT comp, count(*) AS size FROM static GROUP BY comp",
    "lcc_edges": f"""{WITH_GRAPH}, strong AS (SELECT * FROM arcs WHERE cnt >= 2),
        linked AS (SELECT DISTINCT a AS v, a AS root FROM strong UNION SELECT s.b, l.root FROM linked l JOIN strong s ON s.a = l.v),
        static AS (SELECT v, min(root) AS comp FROM linked GROUP BY v),
        top AS (SELECT comp FROM static GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)
        SELECT src, dst, cnt FROM edges JOIN static ON v = src JOIN top USING (comp) WHERE cnt >= 2""",
    "induced_subgraph": f"""{WITH_GRAPH}, chosen AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)
        SELECT src, dst, cnt FROM edges WHERE src IN (FROM chosen) AND dst IN (FROM chosen)""",
    "symmetric_edges": f"{WITH_GRAPH} SELECT a, b, cnt FROM arcs",
    "article_filter": """WITH authors AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_authors FROM lineitem GROUP BY l_orderkey)
        SELECT CASE o_orderpriority[1] WHEN '1' THEN 'article' ELSE 'inproceedings' END || '/' || o_orderkey AS key, year(o_orderdate)::INTEGER AS year, n_authors::INTEGER AS n_authors
        FROM orders JOIN authors ON l_orderkey = o_orderkey
        WHERE n_authors > 1 AND year(o_orderdate) <= 1996 AND o_orderstatus <> 'P' AND o_orderpriority[1] IN ('1', '2')""",
    "world_edge_counts": f"{WITH_ALIVE} SELECT world, count(*) AS n_edges FROM alive GROUP BY world",
    "edge_survival_rate": f"""{WITH_ALIVE} SELECT e.src, e.dst, round(probability, 9) AS probability, round(count(world) / {WORLDS}, 9) AS rate
        FROM edges e LEFT JOIN alive a ON a.src = e.src AND a.dst = e.dst GROUP BY ALL""",
    "world_component_table": f"{WITH_COMPONENTS} SELECT world, vertex, comp FROM components",
    "world_component_sizes": f"{WITH_COMPONENTS} SELECT world, comp, count(*) AS size FROM components GROUP BY ALL",
    "progressive_worlds": f"{WITH_COMPONENTS} SELECT world, count(DISTINCT comp) AS n_components FROM components WHERE world < 40 GROUP BY world",
    "conn_prob_source": f"""{WITH_COMPONENTS}, own AS (SELECT world, comp FROM components WHERE vertex = (SELECT min(vertex) FROM vertices))
        SELECT vertex, round(count(o.world) / {WORLDS}, 9) AS probability FROM components c LEFT JOIN own o ON o.world = c.world AND o.comp = c.comp GROUP BY vertex""",
    "conn_prob_incremental": f"""{WITH_COMPONENTS}, own AS (SELECT world, comp FROM components WHERE vertex = (SELECT min(vertex) FROM vertices))
        SELECT vertex, count(*)::BIGINT AS hits, round(count(*) / {WORLDS}, 9) AS probability FROM components JOIN own USING (world, comp) GROUP BY vertex""",
    "conn_prob_targets": f"""{WITH_COMPONENTS}, own AS (SELECT world, comp FROM components WHERE vertex = (SELECT min(vertex) FROM vertices))
        SELECT vertex, round(count(o.world) / {WORLDS}, 9) AS probability FROM components c LEFT JOIN own o ON o.world = c.world AND o.comp = c.comp
        WHERE vertex IN (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2) GROUP BY vertex""",
    "conn_prob_pairs": f"""{WITH_COMPONENTS} SELECT c.vertex AS a, d.vertex AS b, round(count(*) / {WORLDS}, 9) AS probability
        FROM components c JOIN components d ON d.world = c.world AND d.comp = c.comp AND c.vertex < d.vertex GROUP BY ALL HAVING count(*) / {WORLDS} >= 0.25""",
    "conn_prob_depth2": depth(2),
    "conn_prob_depth4": depth(4),
    "set_reliability": f"""{WITH_COMPONENTS}, per AS (
            SELECT s_nationkey AS set_id, world, count(*) AS size, min(comp) = max(comp) AS whole FROM components JOIN supplier ON s_suppkey = vertex GROUP BY ALL)
        SELECT set_id, max(size) AS size, round(count(*) FILTER (whole) / {WORLDS}, 9) AS reliability FROM per GROUP BY set_id""",
    "avg_conn_prob": f"""{WITH_COMPONENTS}, sizes AS (SELECT count(*) AS s FROM components GROUP BY world, comp), n AS (SELECT count(*) AS n FROM vertices)
        SELECT round(sum(s * s) / {WORLDS} / max(n * (n - 1)), 9) AS avg_conn_prob, round(sum(s * (s - 1)) / {WORLDS} / max(n * (n - 1)), 9) AS avg_pair_prob FROM sizes, n""",
    "sample_sizes": f"""{WITH_GRAPH}
        SELECT p, floor(0.1::DOUBLE / (0.1::DOUBLE * 0.1::DOUBLE * p) * ln(1 / 0.01::DOUBLE))::BIGINT AS clustering, floor(1.0::DOUBLE / (0.1::DOUBLE * 0.1::DOUBLE * p) * ln(1 / 0.01::DOUBLE))::BIGINT AS scoring
        FROM (SELECT DISTINCT round(probability, 6) AS p FROM edges)""",
    "guess_trace": """WITH RECURSIVE
        flags AS (SELECT l_returnflag AS flag, (count(*) FILTER (l_quantity >= 20) * 1000 // count(*)) / 1000 AS valid_up_to FROM lineitem GROUP BY ALL),
        runs AS (SELECT * FROM flags, (VALUES ('exponential', 1, 0.1::DOUBLE), ('exponential', 1, 0.5), ('extended', 2, 0.1)) k(guesser, lag, rate)),
        made AS (
            SELECT flag, guesser, lag, rate, valid_up_to, 0 AS step, 1.0::DOUBLE AS guess, 1.0::DOUBLE AS low, 1.0::DOUBLE AS high, false AS halving FROM runs
            UNION ALL
            SELECT flag, guesser, lag, rate, valid_up_to, step + 1, CASE WHEN h THEN (l + u) / 2 ELSE l END, l, u, h FROM (
                SELECT *, guess <= valid_up_to AS ok,
                       CASE WHEN halving THEN CASE WHEN ok THEN guess ELSE low END WHEN ok THEN low ELSE greatest(1 - rate * 2 ** step, 0.0001) END AS l,
                       CASE WHEN halving THEN CASE WHEN ok THEN high ELSE guess END WHEN ok THEN high
                            WHEN lag = 1 THEN low WHEN step >= 2 THEN 1 - rate * 2 ** (step - 2) ELSE 1 END AS u,
                       halving OR ok OR 1 - rate * 2 ** step <= 0.0001 AS h
                FROM made
            ) WHERE NOT (h AND 1 - l / u <= rate)
        ),
        falling AS (
            SELECT flag, 'geometric' AS guesser, 0.5::DOUBLE AS rate, valid_up_to, 0 AS step, 1.0::DOUBLE AS guess FROM flags
            UNION ALL SELECT flag, guesser, rate, valid_up_to, step + 1, guess * rate FROM falling WHERE guess > valid_up_to AND guess * rate >= 0.0001
        )
        SELECT flag, guesser, rate, valid_up_to, step, round(guess, 9) AS guess FROM made UNION ALL SELECT flag, guesser, rate, valid_up_to, step, round(guess, 9) FROM falling""",
    "assign_fixed_centers": f"{WITH_FIXED} SELECT vertex, center, is_center, round(probability, 9) AS probability FROM fixed",
    "cluster_rebuild": f"""{WITH_FIXED} SELECT f.vertex, f.center, f.vertex = f.center AS is_center, round(count(*) FILTER (c.comp = d.comp) / {WORLDS}, 9) AS probability
        FROM fixed f JOIN components c ON c.vertex = f.vertex JOIN components d ON d.vertex = f.center AND d.world = c.world GROUP BY ALL""",
    "cluster_groups": f"{WITH_FIXED} SELECT center, count(*) AS size, min(vertex) AS first_vertex, max(vertex) AS last_vertex FROM fixed GROUP BY center",
    "mcp_fixed_p": greedy(0.9, 6, 9),
    "acp_fixed_p": greedy(0.97, 4, 4),
    "mcp": minimum(6),
    "mcp_depth": minimum(6, MET_IN_4),
    "acp": average(4),
    "acp_batch": average(4, batch=8),
    "gmm": farthest(),
    "mcl": flow(),
    "pkwik": f"""{WITH_GRAPH}, strong AS (SELECT a, b FROM arcs WHERE probability >= 0.5),
        ordered AS MATERIALIZED (
            SELECT a AS vertex, list(b) AS near, {COIN.format(key=f"'priority', {ALGORITHM_SEED}, 0, a")} AS prio, row_number() OVER (ORDER BY prio, a) AS nth FROM strong GROUP BY a
        ),
        walk AS (SELECT 0::BIGINT AS nth, []::BIGINT[] AS pivots
                 UNION ALL SELECT o.nth, CASE WHEN list_has_any(o.near, w.pivots) THEN w.pivots ELSE list_append(w.pivots, o.vertex) END FROM walk w JOIN ordered o ON o.nth = w.nth + 1),
        pivots AS MATERIALIZED (SELECT unnest(pivots) AS vertex FROM (SELECT pivots FROM walk ORDER BY nth DESC LIMIT 1))
        SELECT o.vertex, CASE WHEN o.vertex IN (FROM pivots) THEN o.vertex ELSE (
            SELECT arg_min(p.vertex, p.nth) FROM ordered p WHERE p.vertex IN (FROM pivots) AND list_contains(o.near, p.vertex)) END AS center
        FROM ordered o""",
    "acp_completion": f"""{WITH_FIXED} SELECT vertex, center, is_center, round(probability, 9) AS probability FROM fixed""",
    "sssp_distances": shortest(),
    "score_basic": f"""{WITH_FIXED} SELECT round(least(1, min(probability)), 9) AS p_min, round(sum(probability), 9) AS probabilities_sum,
        round(avg(probability), 9) AS average_probability, count(*) FILTER (is_center) AS num_clusters FROM fixed""",
    "score_acr": f"""{WITH_FIXED}, per AS (SELECT center, world, count(*) AS size, min(comp) = max(comp) AS whole FROM components JOIN fixed USING (vertex) GROUP BY ALL),
        sets AS (SELECT center, max(size) AS size, count(*) FILTER (whole) / {WORLDS} AS reliability FROM per GROUP BY center)
        SELECT round(sum(size * reliability) / sum(size), 9) AS acr FROM sets""",
    "score_avpr": f"""{WITH_FIXED}, met AS (SELECT world, center, comp, count(*) AS x FROM components JOIN fixed USING (vertex) GROUP BY ALL),
        counted AS (SELECT sum(x * (x - 1) / 2) AS inside, sum(x * (s - x)) AS across FROM met JOIN (SELECT world, comp, count(*) AS s FROM components GROUP BY ALL) USING (world, comp)),
        sizes AS (SELECT sum(c * (c - 1) / 2) AS inside_pairs, sum(c * ((SELECT count(*) FROM vertices) - c)) AS across_pairs FROM (SELECT count(*) AS c FROM fixed GROUP BY center))
        SELECT round(inside / {WORLDS} / inside_pairs, 9) AS inner_avpr, round(across / {WORLDS} / across_pairs, 9) AS outer_avpr FROM counted, sizes""",
    "score_avpr_pairs": f"""{WITH_FIXED}, m AS (SELECT * FROM components JOIN fixed USING (vertex))
        SELECT round(2 * count(*) / {WORLDS} / (SELECT sum(c * (c - 1)) FROM (SELECT count(*) AS c FROM fixed GROUP BY center)), 9) AS inner_avpr
        FROM m a JOIN m b ON a.world = b.world AND a.comp = b.comp AND a.center = b.center AND a.vertex < b.vertex""",
    "score_fill_in": f"""{WITH_FIXED} SELECT 0.125::DOUBLE AS p_min, round(avg(probability), 9) AS average_probability, round(sum(probability), 9) AS probabilities_sum,
        count(*) FILTER (is_center) AS num_clusters FROM fixed""",
    "same_cluster_pairs": f"WITH {WANTED} SELECT a, b FROM wanted",
    "confusion_matrix": f"""{WITH_FIXED}, {WANTED},
        found AS (SELECT a.vertex AS a, b.vertex AS b FROM fixed a JOIN fixed b ON a.center = b.center AND a.vertex < b.vertex
                  WHERE a.vertex IN (SELECT s_suppkey FROM supplier) AND b.vertex IN (SELECT s_suppkey FROM supplier)),
        counts AS (SELECT count(w.a) AS tp, count(*) - count(w.a) AS fp FROM found f LEFT JOIN wanted w ON w.a = f.a AND w.b = f.b)
        {CONFUSION.format(keys="")}""",
    "confusion_by_group": f"""WITH {WANTED},
        actual AS (SELECT depth::INTEGER AS depth, s_suppkey AS member, s_suppkey % depth AS cluster FROM supplier, range(2, 7) t(depth)),
        found AS (SELECT a.depth, a.member AS a, b.member AS b FROM actual a JOIN actual b ON a.depth = b.depth AND a.cluster = b.cluster AND a.member < b.member),
        counts AS (SELECT depth, count(w.a) AS tp, count(*) - count(w.a) AS fp FROM found f LEFT JOIN wanted w ON w.a = f.a AND w.b = f.b GROUP BY depth)
        {CONFUSION.format(keys="depth,")}""",
    "complex_stats": """WITH sizes AS (SELECT count(DISTINCT p_partkey) AS size FROM part GROUP BY p_brand)
        SELECT count(*) AS clusters, min(size) AS min_size, quantile_cont(size, 0.5) AS median_size, round(avg(size), 9) AS mean_size, max(size) AS max_size,
               sum(size * (size - 1) // 2)::BIGINT AS pairs FROM sizes""",
    "complex_filter": """SELECT p_brand AS cluster_id, count(*) AS size FROM part
        WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) GROUP BY p_brand""",
    "annotation_clusters": """SELECT cluster_id, count(*) AS size FROM (
            SELECT p_brand AS cluster_id FROM part UNION ALL SELECT 'size' || p_size FROM part WHERE p_size <= 25
        ) GROUP BY cluster_id""",
    "result_flatten": f"WITH {RUNS} SELECT run, algorithm, input, k, round(p_min, 9) AS p_min, round(p_avg, 9) AS average_probability, time FROM runs",
    "scores_join_perf": f"WITH {RUNS} SELECT run AS date, algorithm, round(p_min, 9) AS p_min, CASE WHEN k <> 3 THEN time END AS time FROM runs",
    "replace_normalize": rf"""WITH {RUNS} SELECT run, CASE algorithm WHEN 'gmm' THEN '\textsc{{gmm}}' WHEN 'k-center' THEN '\textsc{{mcp}}' ELSE '\textsc{{acp}}' END AS algorithm,
        CASE WHEN input LIKE '%collins%' THEN 'Collins' ELSE 'DBLP' END AS input FROM runs""",
    "wanted_rows": f"WITH {RUNS} SELECT run, CASE WHEN input LIKE '%collins%' THEN 'Collins' ELSE 'DBLP' END AS input, k FROM runs WHERE k > 2 AND (input LIKE '%collins%' OR k = 5)",
    "group_mean": f"WITH {RUNS} SELECT algorithm, k, round(avg(p_min), 9) AS p_min, round(avg(time), 9) AS time FROM runs GROUP BY ALL",
    "group_mean_max": f"""WITH {RUNS} SELECT round(max(p_min), 9) AS p_min, round(max(time), 9) AS time
        FROM (SELECT avg(p_min) AS p_min, avg(time) AS time FROM runs GROUP BY k, algorithm, input)""",
    "pivot_depth": f"""WITH {RUNS} SELECT k, round(avg(time) FILTER (algorithm = 'gmm'), 9) AS gmm, round(avg(time) FILTER (algorithm = 'k-center'), 9) AS k_center,
        round(avg(time) FILTER (algorithm = 'k-median'), 9) AS k_median FROM runs GROUP BY k""",
    "unpivot_measures": f"""WITH {RUNS} SELECT run, 'p_min' AS measure, round(p_min, 9) AS value FROM runs
        UNION ALL SELECT run, 'average probability', round(p_avg, 9) FROM runs UNION ALL SELECT run, 'time', time FROM runs""",
    "union_by_name": f"""WITH {RUNS} SELECT run, CASE WHEN algorithm = 'gmm' THEN round(p_min, 9) END AS p_min, CASE WHEN algorithm <> 'gmm' THEN k END AS k FROM runs""",
    "number_formats": rf"""WITH {RUNS} SELECT run, '$' || printf('%.3f', round(round(p_min, 6), 3))[2:] || '$' AS point,
        '$' || replace(printf('%.3E', round(time, 3)), 'E', '\cdot 10^{{') || '}}$' AS exponent FROM runs""",
}

#: Relaxed, expanded or normalised step by step.
ORACLE["mcl_step"] = f"""{WITH_GRAPH},
    start AS (SELECT a AS i, b AS j, probability AS v FROM arcs UNION ALL SELECT b, b, max(probability) FROM arcs GROUP BY b),
    m AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM start),
    squared AS (SELECT l.i, r.j, sum(l.v * r.v) AS v FROM m l JOIN m r ON l.j = r.i GROUP BY l.i, r.j)
    SELECT i, j, round(v * v / sum(v * v) OVER (PARTITION BY j), 9) AS v FROM squared WHERE v >= 1e-3"""

ORACLE["edge_list_file"] = f"{WITH_GRAPH} SELECT least('s' || src, 's' || dst) AS a, greatest('s' || src, 's' || dst) AS b, round(floor(probability * 1024) / 1024, 9) AS probability FROM edges"
ORACLE["label_lookup"] = f"{LINES} SELECT label, vertex FROM dictionary ORDER BY label DESC LIMIT 1"
ORACLE["cluster_lines_file"] = """WITH sized AS (SELECT s_nationkey, row_number() OVER (ORDER BY count(*) DESC, s_nationkey) - 1 AS cluster_id FROM supplier GROUP BY s_nationkey)
    SELECT cluster_id, 's' || s_suppkey AS member FROM supplier JOIN sized USING (s_nationkey)"""
ORACLE["clustering_document"] = f"""{WITH_FIXED}
    SELECT vertex AS id, center, 's' || vertex AS label, 's' || center AS center_label, round(probability, 9) AS probability, 'mcp' AS algorithm, {CENTERS}::BIGINT AS k FROM fixed"""
ORACLE["confusion_of_files"] = ORACLE["confusion_matrix"]
ORACLE["scored_document"] = f"""WITH {RUNS}, means AS (SELECT algorithm, k, avg(time) AS time FROM runs GROUP BY ALL)
    SELECT run, 'lines' AS graph, algorithm, k, r.time AS run_time, round(m.time, 9) AS time FROM runs r JOIN means m USING (algorithm, k)"""
ORACLE["json_lines_file"] = f"WITH {RUNS} SELECT run, k, time, 'pkwik' AS algorithm FROM runs"
ORACLE["known_complexes_file"] = f"""{WITH_GRAPH}, known AS (SELECT src AS s FROM edges WHERE cnt >= 2 UNION SELECT dst FROM edges WHERE cnt >= 2)
    SELECT 'n' || s_nationkey AS cluster_id, 'S' || s_suppkey AS member FROM supplier WHERE s_suppkey IN (FROM known)"""
ORACLE["annotation_file"] = ORACLE["annotation_clusters"]
ORACLE["xml_records"] = """WITH authors AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey)
    SELECT 'journals/' || o_orderkey AS key, year(o_orderdate) AS year, array_to_string(list_transform(s, lambda x: 'Supplier_' || x), ' ') AS authors
    FROM orders JOIN authors ON l_orderkey = o_orderkey"""
ORACLE["cached_means"] = f"WITH {RUNS} SELECT k, round(avg(time), 9) AS time FROM runs GROUP BY k"
ORACLE["conn_prob_depth_targets"] = f"SELECT * FROM ({depth(2)}) WHERE vertex IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 = 2)"
ORACLE["qualifying_vertices"] = f"""{WITH_COMPONENTS}, near AS (
        SELECT o.vertex FROM components c JOIN components o ON o.world = c.world AND o.comp = c.comp WHERE c.vertex = (SELECT min(vertex) FROM vertices)
        GROUP BY o.vertex HAVING count(*) / {WORLDS} >= 0.9)
    SELECT count(*) AS qualifying FROM near"""
ORACLE["guesses_made"] = f"""{searched(6)}
    SELECT guess::BIGINT AS iteration, CASE guess {" ".join(f"WHEN {g} THEN {p}::DOUBLE" for g, (p, _) in enumerate(GUESSES))} END AS p_curr, count(*) FILTER (center IS NULL) AS uncovered
    FROM every WHERE guess <= (SELECT g FROM first_valid) GROUP BY guess"""
ORACLE["all_scores"] = f"""{WITH_FIXED}, per AS (SELECT center, world, count(*) AS size, min(comp) = max(comp) AS whole FROM components JOIN fixed USING (vertex) GROUP BY ALL),
    sets AS (SELECT center, max(size) AS size, count(*) FILTER (whole) / {WORLDS} AS reliability FROM per GROUP BY center),
    met AS (SELECT world, center, comp, count(*) AS x FROM components JOIN fixed USING (vertex) GROUP BY ALL),
    counted AS (SELECT sum(x * (x - 1) / 2) AS inside, sum(x * (s - x)) AS across FROM met JOIN (SELECT world, comp, count(*) AS s FROM components GROUP BY ALL) USING (world, comp)),
    sizes AS (SELECT sum(c * (c - 1) / 2) AS inside_pairs, sum(c * ((SELECT count(*) FROM vertices) - c)) AS across_pairs FROM (SELECT count(*) AS c FROM fixed GROUP BY center)),
    basic AS (SELECT round(least(1, min(probability)), 9) AS p_min, round(sum(probability), 9) AS probabilities_sum, round(avg(probability), 9) AS average_probability, count(*) FILTER (is_center) AS num_clusters FROM fixed)
    SELECT basic.*, (SELECT round(sum(size * reliability) / sum(size), 9) FROM sets) AS acr,
           round(inside / {WORLDS} / inside_pairs, 9) AS inner_avpr, round(across / {WORLDS} / across_pairs, 9) AS outer_avpr FROM basic, counted, sizes"""
PART_GROUPS = "groups AS (SELECT p_brand AS c, p_partkey AS m FROM part UNION ALL SELECT 'size' || p_size, p_partkey FROM part)"
ORACLE["overlapping_pair_counts"] = f"""WITH {PART_GROUPS}
    SELECT (SELECT count(*) FROM (SELECT DISTINCT a.m, b.m FROM groups a JOIN groups b ON a.c = b.c AND a.m < b.m)) AS distinct_pairs,
           (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT count(*) AS n FROM groups GROUP BY c)) AS summed_pairs"""
ORACLE["confusion_overlapping"] = f"""WITH {PART_GROUPS},
    kinds AS (SELECT p_name AS c, p_partkey AS m FROM part UNION ALL SELECT p_type || ' ' || p_brand, p_partkey FROM part),
    wanted AS MATERIALIZED (SELECT DISTINCT a.m AS a, b.m AS b FROM kinds a JOIN kinds b ON a.c = b.c AND a.m < b.m),
    found AS (SELECT DISTINCT a.m AS a, b.m AS b FROM groups a JOIN groups b ON a.c = b.c AND a.m < b.m),
    counts AS (SELECT count(w.a) AS tp, count(*) - count(w.a) AS fp FROM found f LEFT JOIN wanted w ON w.a = f.a AND w.b = f.b)
    {CONFUSION.format(keys="").replace("FROM supplier", "FROM part")}"""
ORACLE["distinct_members"] = "SELECT count(*) AS members FROM part"
ORACLE["scalability_means"] = f"WITH {RUNS} SELECT k, algorithm, round(avg(time), 9) AS time FROM runs WHERE input = 'data/collins-lcc.txt' GROUP BY ALL"
ORACLE["figure_rows"] = rf"""WITH {RUNS}, shown AS (
        SELECT CASE WHEN input LIKE '%collins%' THEN 'Collins' ELSE 'DBLP' END AS input, k * 2 AS k,
               CASE algorithm WHEN 'gmm' THEN '\textsc{{gmm}}' WHEN 'k-center' THEN '\textsc{{mcp}}' ELSE '\textsc{{acp}}' END AS algorithm, p_min, p_avg, time
        FROM runs WHERE k * 2 > 3 AND input LIKE '%collins%')
    SELECT 'figure-1' AS figure, input, k, algorithm, '$p_{{min}}$' AS measure, round(avg(p_min), 9) AS value FROM shown GROUP BY ALL
    UNION ALL SELECT 'figure-1', input, k, algorithm, '$p_{{avg}}$', round(avg(p_avg), 9) FROM shown GROUP BY ALL
    UNION ALL SELECT 'figure-3', input, k, algorithm, 'time (ms)', round(avg(time), 9) FROM shown GROUP BY ALL"""
ORACLE["prediction_table"] = f"""WITH {WANTED},
    actual AS (SELECT algorithm, depth::INTEGER AS depth, s_suppkey AS member, (CASE algorithm WHEN 'mcp' THEN s_suppkey ELSE s_suppkey // 3 END) % depth AS cluster
               FROM supplier, range(2, 7) t(depth), (VALUES ('mcp'), ('acp')) a(algorithm)),
    found AS (SELECT a.algorithm, a.depth, a.member AS a, b.member AS b FROM actual a JOIN actual b ON a.algorithm = b.algorithm AND a.depth = b.depth AND a.cluster = b.cluster AND a.member < b.member),
    counts AS (SELECT algorithm, depth, count(w.a) AS tp, count(*) - count(w.a) AS fp FROM found f LEFT JOIN wanted w ON w.a = f.a AND w.b = f.b GROUP BY ALL),
    rates AS ({CONFUSION.format(keys="algorithm, depth,")})
    SELECT depth, avg(tpr) FILTER (algorithm = 'acp') AS acp_tpr, avg(fpr) FILTER (algorithm = 'acp') AS acp_fpr,
           avg(tpr) FILTER (algorithm = 'mcp') AS mcp_tpr, avg(fpr) FILTER (algorithm = 'mcp') AS mcp_fpr FROM rates GROUP BY depth"""
