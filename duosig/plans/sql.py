"""SQL for DuckDB that states the catalogue's queries over the same tables."""

from __future__ import annotations

CTES = {
    "raw": """raw AS (SELECT n_regionkey::BIGINT AS gene, l_orderkey AS read, l_linenumber::BIGINT AS pos, l_orderkey % 2 AS cond, 1 + (l_orderkey // 2) % 2 AS rep,
  60 + o_totalprice / 50000 + 0.02::DOUBLE * l_quantity + CASE WHEN l_orderkey % 2 = 1 AND l_linenumber IN (3, 4) AND l_orderkey % 3 > 0 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS mean,
  l_tax * 16 AS duration, l_shipdate, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "dd": "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cond, rep, gene, read, pos ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS k FROM raw) WHERE k = 1)",
    "ev": "ev AS (SELECT * FROM dd WHERE duration <= 1)",
    "vp": """dep AS (SELECT gene, cond, rep, pos, count(*) AS n FROM ev GROUP BY ALL),
reps AS (SELECT gene, cond, count(DISTINCT rep) AS reps FROM ev GROUP BY ALL),
good AS (SELECT d.gene, d.cond, d.pos FROM dep d JOIN reps r ON d.gene = r.gene AND d.cond = r.cond WHERE d.n >= 6 GROUP BY d.gene, d.cond, d.pos, r.reps HAVING count(*) = r.reps),
vp AS (SELECT gene, pos FROM good GROUP BY gene, pos HAVING count(*) = 2)""",
    "vw": "vw AS (SELECT gene, pos AS centre FROM (SELECT *, count(*) OVER (PARTITION BY gene ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM vp) WHERE n = 3)",
    "vec0": """vec0 AS (SELECT w.gene, w.centre, a.cond, a.rep, a.read, a.mean AS v0, b.mean AS v1, c.mean AS v2 FROM vw w
  JOIN ev a ON a.gene = w.gene AND a.pos = w.centre - 1 JOIN ev b ON b.gene = w.gene AND b.pos = w.centre AND b.read = a.read JOIN ev c ON c.gene = w.gene AND c.pos = w.centre + 1 AND c.read = a.read)""",
    "deep": """nrep AS (SELECT gene, count(DISTINCT cond * 10 + rep) AS reps FROM vec0 GROUP BY gene),
deep AS (SELECT d.gene, d.centre, min(d.n) AS depth FROM (SELECT gene, centre, cond, rep, count(*) AS n FROM vec0 GROUP BY ALL) d JOIN nrep r ON d.gene = r.gene
  GROUP BY d.gene, d.centre, r.reps HAVING min(d.n) >= 6 AND count(*) = r.reps)""",
    "vec": "vec AS (SELECT v.* FROM vec0 v JOIN deep d ON v.gene = d.gene AND v.centre = d.centre)",
    "comp": """st AS (SELECT gene, centre, avg(v0) AS m0, avg(v1) AS m1, avg(v2) AS m2, stddev_pop(v0) AS s0, stddev_pop(v1) AS s1, stddev_pop(v2) AS s2,
  covar_pop(v0, v1) AS c01, covar_pop(v0, v2) AS c02, covar_pop(v1, v2) AS c12 FROM vec GROUP BY gene, centre),
rr AS (SELECT *, c01 / (s0 * s1) AS r01, c02 / (s0 * s2) AS r02, c12 / (s1 * s2) AS r12 FROM st WHERE s0 > 0 AND s1 > 0 AND s2 > 0),
pw(gene, centre, i, a, b, c, d, e, f) AS (SELECT gene, centre, 0, 1.0::DOUBLE, r01, r02, 1.0::DOUBLE, r12, 1.0::DOUBLE FROM rr UNION ALL
  SELECT gene, centre, i + 1, aa / t, ab / t, ac / t, bb / t, bc / t, cc / t FROM
  (SELECT gene, centre, i, a * a + b * b + c * c AS aa, a * b + b * d + c * e AS ab, a * c + b * e + c * f AS ac, b * b + d * d + e * e AS bb, b * c + d * e + e * f AS bc, c * c + e * e + f * f AS cc,
    a * a + d * d + f * f + 2 * (b * b + c * c + e * e) AS t FROM pw WHERE i < 12)),
vc AS (SELECT gene, centre, x / sqrt(x * x + y * y + z * z) AS a, y / sqrt(x * x + y * y + z * z) AS b, z / sqrt(x * x + y * y + z * z) AS c FROM
  (SELECT gene, centre, a + 0.9::DOUBLE * b + 0.8::DOUBLE * c AS x, b + 0.9::DOUBLE * d + 0.8::DOUBLE * e AS y, c + 0.9::DOUBLE * e + 0.8::DOUBLE * f AS z FROM pw WHERE i = 12)),
comp AS (SELECT v.gene, v.centre, v.cond, v.rep, v.read, round((v0 - m0) / s0 * a + (v1 - m1) / s1 * b + (v2 - m2) / s2 * c, 6) AS value
  FROM vec v JOIN rr r ON v.gene = r.gene AND v.centre = r.centre JOIN vc p ON p.gene = v.gene AND p.centre = v.centre)""",
}
VECTORS = ("raw", "dd", "ev", "vp", "vw", "vec0", "deep", "vec")


def _kolmogorov(x: str) -> str:
    return f"CASE WHEN {x} < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2 * k * k * ({x}) * ({x})))), 0), 1) END"


def _ks(source: str, by: str, value: str) -> str:
    """CTEs that end in ks(by, n0, n1, d, p)."""
    return f"""each AS (SELECT {by}, {value} AS v, sum((cond = 0)::BIGINT)::BIGINT AS a, sum((cond = 1)::BIGINT)::BIGINT AS b FROM {source} GROUP BY ALL),
cum AS (SELECT {by}, sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER w AS n0, sum(b) OVER w AS n1 FROM each
  WINDOW u AS (PARTITION BY {by} ORDER BY v ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY {by})),
dd2 AS (SELECT {by}, n0::BIGINT AS n0, n1::BIGINT AS n1, max(abs(ca::DOUBLE / n0 - cb::DOUBLE / n1)) AS d FROM cum WHERE n0 > 0 AND n1 > 0 GROUP BY ALL),
xx AS (SELECT *, sqrt(n0::DOUBLE * n1 / (n0 + n1)) AS en FROM dd2),
ks AS (SELECT *, {_kolmogorov('((en + 0.12::DOUBLE + 0.11::DOUBLE / en) * d)')} AS p FROM xx)"""


def _chi2(g: str) -> str:
    z = f"sqrt(greatest({g}, 0) / 2)"
    terms = " + ".join(f"pow({z}, {2 * k + 1}) * {float(_ratio(k))!r}::DOUBLE" for k in range(25))
    series = f"1 - 2 / sqrt(pi()) * exp(-pow({z}, 2)) * ({terms})"
    craig = f"list_sum(list_transform(range(0, 64), lambda i: exp(-pow({z}, 2) / pow(sin((i + 0.5::DOUBLE) * pi() / 128), 2)))) / 64"
    return f"CASE WHEN {z} < 0.5 THEN {series} ELSE {craig} END"


def _ratio(k: int) -> float:
    out = 1.0
    for i in range(1, k + 1):
        out *= 2 / (2 * i + 1)
    return out


def _g(table: list[list[str]], yates: bool) -> str:
    rows = ["(" + " + ".join(r) + ")" for r in table]
    cols = ["(" + " + ".join(r[j] for r in table) + ")" for j in range(len(table[0]))]
    total = "(" + " + ".join(rows) + ")"
    terms = []
    for i, r in enumerate(table):
        for j, o in enumerate(r):
            e = f"({rows[i]} * {cols[j]} / {total})"
            o2 = f"({o} + sign({e} - {o}) * least(0.5::DOUBLE, abs({e} - {o})))" if yates else o
            terms.append(f"CASE WHEN {o2} > 0 THEN 2 * {o2} * ln({o2} / {e}) ELSE 0.0::DOUBLE END")
    empty = " OR ".join(f"{x} <= 0" for x in (*rows, *cols))
    return f"CASE WHEN {empty} THEN 0.0::DOUBLE ELSE greatest({' + '.join(terms)}, 0) END"


COUNTS = (
    "cc AS (SELECT o_orderpriority, "
    + ", ".join(f"sum((o_custkey % 2 = {c} AND (o_custkey // 2) % 2 = {r} AND o_orderstatus = '{s}')::INT)::DOUBLE AS {'ct'[c]}{r}{s}" for c in (0, 1) for r in (0, 1) for s in "FOP")
    + " FROM orders GROUP BY o_orderpriority), cells AS (SELECT *, c0F + c1F AS a, c0O + c1O AS b, t0F + t1F AS c, t0O + t1O AS d FROM cc)"
)
FDR = """fdr AS (SELECT *, least(min(x) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING), 1) AS fdr FROM
  (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, gene, pos) AS x, row_number() OVER (ORDER BY p, gene, pos) AS k FROM ks))"""
HALF = "CASE WHEN {x} = 0 THEN 0.0::DOUBLE WHEN abs({x}) >= 65520 THEN sign({x}) * 'inf'::DOUBLE ELSE round_even({x} / pow(2, greatest(floor(log2(abs({x}))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs({x}))), -14) - 10) END"
FEATURES = """ft AS (SELECT o_custkey::VARCHAR AS transcript_id, o_orderkey * 100 AS s, o_orderkey * 100 + 50 + o_orderkey % 50 AS e, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderpriority, o_orderkey FROM orders),
ex AS (SELECT transcript_id, strand, s, e, first_value(o_orderpriority) OVER (PARTITION BY transcript_id ORDER BY o_orderkey) AS gene_id,
  coalesce(sum(e - s) OVER (PARTITION BY transcript_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cs, (sum(e - s) OVER (PARTITION BY transcript_id))::BIGINT AS ln FROM ft)"""
ANNOTATION = """an AS (SELECT s_suppkey, s_nationkey, 'gene_id "' || n_name || '"; level ' || s_nationkey || '; transcript_id "' || s_name || '"; gene_id "G' || s_suppkey || '";' AS attrs FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
KMERS = "km AS (SELECT p_partkey % 5 AS gene, p_size::BIGINT AS pos, arg_max(p_brand, (p_partkey % 4) * 1000000000 + p_partkey) AS kmer FROM part GROUP BY ALL)"
MODEL = "md AS (SELECT kmer, round(avg(x), 4) AS level_mean FROM (SELECT p_brand AS kmer, p_retailprice AS x FROM part UNION ALL SELECT p_type, p_retailprice FROM part) GROUP BY kmer)"
SHIFTS = """rs AS (SELECT p_partkey AS id, p_brand AS kmer, p_retailprice AS m1, p_size * 40.0::DOUBLE AS m2 FROM part UNION ALL SELECT p_partkey, p_type, p_size * 30.0::DOUBLE, p_retailprice / 2 FROM part),
sh AS (SELECT r.kmer, (median(abs(greatest(m1, m2) - level_mean)) > median(abs(least(m1, m2) - level_mean)))::INT AS up FROM rs r JOIN md ON r.kmer = md.kmer GROUP BY r.kmer),
ori AS (SELECT id, sum(CASE WHEN (up = 1) <> (m1 - m2 < 0) THEN abs(m1 - m2) ELSE 0 END) > sum(CASE WHEN (up = 1) <> (m1 - m2 < 0) THEN 0 ELSE abs(m1 - m2) END) AS flip FROM rs r JOIN sh ON r.kmer = sh.kmer GROUP BY id)"""
LABEL = "lb AS (SELECT *, CASE WHEN mean < 66 THEN 0 WHEN mean < 72 THEN 1 ELSE 2 END AS label FROM ev)"
WEIGHTS = "cw AS (SELECT gene, pos, cond, rep, count(*) AS n, " + ", ".join(f"(sum((label = {k})::INT) + 0.5::DOUBLE) / (count(*) + 1.5::DOUBLE) AS w{k}" for k in range(3)) + " FROM lb GROUP BY ALL)"
CIGAR = "al AS (SELECT *, l_quantity::INT AS q, [l_linenumber::BIGINT, l_partkey % 20, l_suppkey % 9] AS gaps FROM lineitem)"


def _with(*names: str, more: tuple[str, ...] = (), recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*(CTES[n] for n in names), *more]) + "\n"


def _em(steps: int) -> str:
    pdf = lambda mu, v: f"exp(-(((value - {mu}) / sqrt({v})) * ((value - {mu}) / sqrt({v}))) / 2) / (sqrt({v}) * 2.5066282746310002::DOUBLE)"
    out = ["WITH p0 AS (SELECT event_type, 0.5::DOUBLE AS w1, avg(value) - sqrt(var_pop(value)) AS mu1, avg(value) + sqrt(var_pop(value)) AS mu2, var_pop(value) AS v1, var_pop(value) AS v2 FROM events GROUP BY event_type)"]
    for k in range(steps):
        out.append(f"""r{k} AS (SELECT e.event_type, value AS x, d1 / (d1 + d2) AS r FROM (SELECT e.event_type, value, w1 * {pdf('mu1', 'v1')} AS d1, (1 - w1) * {pdf('mu2', 'v2')} AS d2 FROM events e JOIN p{k} p ON e.event_type = p.event_type) e),
s{k} AS (SELECT event_type, count(*) AS n, sum(r) AS s1, sum(r * x) AS x1, sum(r * x * x) AS q1, sum(x) AS x, sum(x * x) AS q FROM r{k} GROUP BY event_type),
p{k + 1} AS (SELECT event_type, s1 / n AS w1, x1 / s1 AS mu1, (x - x1) / (n - s1) AS mu2, greatest(q1 / s1 - pow(x1 / s1, 2), 1e-6) AS v1, greatest((q - q1) / (n - s1) - pow((x - x1) / (n - s1), 2), 1e-6) AS v2 FROM s{k})""")
    return ",\n".join(out) + f"\nSELECT event_type, round(w1, 4) AS w1, round(mu1, 4) AS mu1, round(mu2, 4) AS mu2, round(v1, 4) AS v1, round(v2, 4) AS v2 FROM p{steps}"


def _em_windows(steps: int) -> str:
    """CTEs from vec to the parameters of each window after so many steps of a mixture of two Gaussians and a box, with weights of each sample's own."""
    lower = [(i, j) for i in range(3) for j in range(i + 1)]
    key, sample = "gene, centre", "gene, centre, cond, rep"
    join = lambda f, parts: ", ".join(f(*x) for x in parts)
    both = [(k, i) for k in (1, 2) for i in range(3)]
    cells = [(k, i, j) for k in (1, 2) for i, j in lower]
    out = [f"""ax AS (SELECT {key}, avg(v0) AS a0, avg(v1) AS a1, avg(v2) AS a2 FROM vec GROUP BY {key}),
xs AS (SELECT {', '.join('v.' + c for c in sample.split(', '))}, v0 - a0 AS x0, v1 - a1 AS x1, v2 - a2 AS x2, CASE WHEN (v0 + v1 + v2) / 3 < 65 THEN 0 WHEN (v0 + v1 + v2) / 3 < 75 THEN 1 ELSE 2 END AS label, CASE WHEN (v0 + v1 + v2) / 3 < 70 THEN 0 ELSE 1 END AS nearer
  FROM vec v JOIN ax a ON v.gene = a.gene AND v.centre = a.centre),
ini AS (SELECT {key}, count(*) FILTER (nearer = 0) AS b1, count(*) FILTER (nearer = 1) AS b2, """
        + join(lambda k, i: f"CASE WHEN count(*) FILTER (label = {k - 1}) > 3 THEN avg(x{i}) FILTER (label = {k - 1}) ELSE avg(x{i}) FILTER (nearer = {k - 1}) END AS m{k}{i}", both) + ", "
        + join(lambda k, i, j: f"CASE WHEN count(*) FILTER (label = {k - 1}) > 3 THEN covar_pop(x{i}, x{j}) FILTER (label = {k - 1}) ELSE covar_pop(x{i}, x{j}) FILTER (nearer = {k - 1}) END AS c{k}{i}{j}", cells) + ", "
        + ", ".join(f"coalesce(min(x{i}) FILTER (label = 2), min(x{i})) AS low{i}, coalesce(max(x{i}) FILTER (label = 2), max(x{i})) AS high{i}" for i in range(3)) + f""" FROM xs GROUP BY {key}),
sw0 AS (SELECT {sample}, count(*) AS used, """ + ", ".join(f"(count(*) FILTER (label = {k}) + 0.5::DOUBLE) / (count(*) + 1.5::DOUBLE) AS w{k}" for k in range(3)) + f""" FROM xs GROUP BY {sample}),
pp0 AS (SELECT * FROM ini WHERE b1 > 0 AND b2 > 0)"""]  # fmt: skip
    for t in range(steps):
        keep = repr(1 - 0.99 * (3.0 + t) ** -0.001) + "::DOUBLE"
        rest = repr(0.99 * (3.0 + t) ** -0.001) + "::DOUBLE"
        first = ", ".join(f"sqrt(c{k}00) AS l{k}00, c{k}10 / sqrt(c{k}00) AS l{k}10, c{k}20 / sqrt(c{k}00) AS l{k}20" for k in (1, 2))
        second = ", ".join(f"sqrt(c{k}11 - l{k}10 * l{k}10) AS l{k}11, (c{k}21 - l{k}20 * l{k}10) / sqrt(c{k}11 - l{k}10 * l{k}10) AS l{k}21" for k in (1, 2))
        third = ", ".join(f"sqrt(c{k}22 - l{k}20 * l{k}20 - l{k}21 * l{k}21) AS l{k}22" for k in (1, 2))
        solve = ["", ", ".join(f"(x0 - m{k}0) / l{k}00 AS z{k}0" for k in (1, 2)), ", ".join(f"(x1 - m{k}1 - l{k}10 * z{k}0) / l{k}11 AS z{k}1" for k in (1, 2)), ", ".join(f"(x2 - m{k}2 - l{k}20 * z{k}0 - l{k}21 * z{k}1) / l{k}22 AS z{k}2" for k in (1, 2))]
        dens = ", ".join(f"w{k - 1} * exp(-(z{k}0 * z{k}0 + z{k}1 * z{k}1 + z{k}2 * z{k}2) / 2) / (pow(2 * pi(), 1.5::DOUBLE) * l{k}00 * l{k}11 * l{k}22) AS f{k - 1}" for k in (1, 2))
        inside = " AND ".join(f"x{i} BETWEEN low{i} AND high{i}" for i in range(3))
        width = " * ".join(f"greatest(high{i} - low{i}, 1e-6::DOUBLE)" for i in range(3))
        out.append(f"""tri{t} AS (SELECT *, {third} FROM (SELECT *, {second} FROM (SELECT *, {first} FROM pp{t}))),
joined{t} AS (SELECT x.{sample.replace(', ', ', x.')}, x0, x1, x2, w0, w1, w2, q.* EXCLUDE ({key}) FROM xs x JOIN tri{t} q ON x.gene = q.gene AND x.centre = q.centre JOIN sw{t} s ON x.gene = s.gene AND x.centre = s.centre AND x.cond = s.cond AND x.rep = s.rep),
den{t} AS (SELECT {sample}, x0, x1, x2, {dens}, CASE WHEN {inside} THEN w2 / ({width}) ELSE 0 END AS f2 FROM (SELECT *, {solve[3]} FROM (SELECT *, {solve[2]} FROM (SELECT *, {solve[1]} FROM joined{t})))),
res{t} AS (SELECT {sample}, x0, x1, x2, f0 / (f0 + f1 + f2) AS r1, f1 / (f0 + f1 + f2) AS r2, f2 / (f0 + f1 + f2) AS r3 FROM den{t}),
sum{t} AS (SELECT {key}, sum(r1) AS n1, sum(r2) AS n2, {join(lambda k, i: f'sum(r{k} * x{i}) / sum(r{k}) AS u{k}{i}', both)}, {join(lambda k, i, j: f'sum(r{k} * x{i} * x{j}) / sum(r{k}) AS q{k}{i}{j}', cells)} FROM res{t} GROUP BY {key}),
sw{t + 1} AS (SELECT {sample}, count(*) AS used, {', '.join(f'(sum(r{k + 1}) + 0.5::DOUBLE) / (count(*) + 1.5::DOUBLE) AS w{k}' for k in range(3))} FROM res{t} GROUP BY {sample}),
pp{t + 1} AS (SELECT p.gene, p.centre, {join(lambda k, i: f'{keep} * m{k}{i} + {rest} * u{k}{i} AS m{k}{i}', both)}, {join(lambda k, i, j: f'{keep} * c{k}{i}{j} + {rest} * (q{k}{i}{j} - u{k}{i} * u{k}{j}) AS c{k}{i}{j}', cells)},
  {', '.join(f'low{i}, high{i}' for i in range(3))} FROM pp{t} p JOIN sum{t} s ON p.gene = s.gene AND p.centre = s.centre)""")
    last = f"ww AS (SELECT {key}, {', '.join(f'sum(w{k} * used) / sum(used) AS w{k}' for k in range(3))} FROM sw{steps} GROUP BY {key})"
    picked = ", ".join([*(f"round(m{k}{i} + a{i}, 4) AS mu{k}_{i}" for k, i in both), *(f"round(c{k}{i}{j}, 4) AS c{k}_{i}{j}" for k, i, j in cells), *(f"round(w{k}, 4) AS w{k}" for k in range(3))])
    return _with(*VECTORS, more=(*out, last)) + f"SELECT p.gene, p.centre, {picked} FROM pp{steps} p JOIN ww w ON p.gene = w.gene AND p.centre = w.centre JOIN ax a ON p.gene = a.gene AND p.centre = a.centre"


def statements() -> dict[str, str]:
    e, v = ("raw", "dd", "ev"), VECTORS
    ksp = _with(*e, more=(_ks("ev", "gene, pos", "mean"),))
    ksf = _with(*e, more=(_ks("ev", "gene, pos", "mean"), FDR))
    pca = _with(*v, "comp", recursive=True)
    pks = _with(*v, "comp", more=(_ks("comp", "gene, centre", "value"),), recursive=True)
    reps = lambda c: [[f"{c}{r}{s}" for s in "FOP"] for r in (0, 1)]
    het = _g([["a", "b"], ["c", "d"]], True)
    pick = lambda n: f"regexp_extract_all(attrs, '([A-Za-z0-9_]+)\\s+\"([^\"]+)\"', {n})"
    last = lambda key: f"list_filter(list_zip({pick(1)}, {pick(2)}), lambda x: x[1] = '{key}')[-1][2]"
    gn = lambda m: f"((gene * 31 + pos * 17) % {m})::DOUBLE"
    two = lambda x: f"CASE WHEN {x} IS NULL THEN 'nan' ELSE printf('%.2f', {x}) END"
    dens = ["0.5::DOUBLE * exp(-pow((value - 20) / 15.0::DOUBLE, 2) / 2) / (15 * 2.5066282746310002::DOUBLE)", "0.3::DOUBLE * exp(-pow((value - 60) / 25.0::DOUBLE, 2) / 2) / (25 * 2.5066282746310002::DOUBLE)", "CASE WHEN value BETWEEN 0 AND 200 THEN 0.2::DOUBLE / 200 ELSE 0 END"]
    swap = lambda a, b: f"round(CASE WHEN flip THEN {b} ELSE {a} END, 6)"
    mean3 = "(v0 + v1 + v2) / 3"
    return {
        "scan_project_cast": "SELECT 't' || l_suppkey AS t_id, l_linenumber::BIGINT + 2 AS pos, l_returnflag || l_linestatus AS kmer, l_orderkey::VARCHAR AS r_id, l_extendedprice AS mean, l_discount AS std, l_tax AS duration, l_linenumber::BIGINT AS points FROM lineitem",
        "lookup_read_names": "SELECT c_custkey::VARCHAR AS read_index, c_name, n AS read_name FROM customer JOIN (SELECT o_custkey, arg_max(o_orderpriority || ' ' || o_orderkey, o_orderkey) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
        "gtf_attrs": f"WITH {ANNOTATION} SELECT s_suppkey, {last('gene_id')} AS gene_id, {last('transcript_id')} AS transcript_id, len(list_distinct({pick(1)}))::BIGINT AS n_keys FROM an",
        "gtf_parse": f"WITH {ANNOTATION} SELECT 'chr' || s_nationkey AS chrom, s_suppkey * 10 - 1 AS start, s_suppkey * 10 + 99 AS \"end\", '+' AS strand, {last('transcript_id')} AS transcript_id FROM an WHERE s_suppkey % 10 <> 0 AND s_suppkey % 3 <> 0",
        "exon_cumsum": f"WITH {FEATURES} SELECT transcript_id, gene_id, s AS start, cs, ln FROM ex",
        "liftover": f"""WITH {FEATURES}, sz AS (SELECT DISTINCT transcript_id, ln, strand FROM ex),
pl AS (SELECT z.transcript_id, z.strand, l_partkey % ln AS pos, CASE WHEN z.strand = '-' THEN ln - l_partkey % ln - 1 ELSE l_partkey % ln END AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sz z ON z.transcript_id = o_custkey::VARCHAR)
SELECT a.transcript_id, a.strand, a.pos, ex.s + a.p - ex.cs AS gpos, count(*) AS n FROM pl a JOIN ex ON a.transcript_id = ex.transcript_id AND ex.cs <= a.p AND a.p < ex.cs + ex.e - ex.s GROUP BY ALL""",
        "run_collapse": """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, round(sum(value), 6) AS duration FROM b GROUP BY ALL""",
        "run_collapse_splits": """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c, abs(value) / 10 AS s, (event_id % 20 + 1)::DOUBLE AS k FROM events),
b AS (SELECT *, sum(c) OVER (ORDER BY event_id) AS run FROM a), y AS (SELECT event_type, count(*) AS n, sum(k * value) / sum(k) AS a, sum(k * s * s) / sum(k) + sum(k * value * value) / sum(k) AS q, sum(value) AS duration, any_value(value) AS m, any_value(s) AS s FROM b GROUP BY event_type, run)
SELECT event_type, n, round(CASE WHEN n = 1 THEN m ELSE a END, 4) AS mean, round(CASE WHEN n = 1 THEN s ELSE sqrt(greatest(q - a * a, 0)) END, 4) AS std, round(duration, 4) AS duration FROM y""",
        "pooled_stats": """WITH x AS (SELECT user_id, event_type, value AS m, abs(value) / 10 AS s, (event_id % 20 + 1)::DOUBLE AS k FROM events),
y AS (SELECT user_id, event_type, count(*) AS c, sum(k * m) / sum(k) AS a, sum(k * s * s) / sum(k) + sum(k * m * m) / sum(k) AS q, any_value(m) AS m, any_value(s) AS s FROM x GROUP BY ALL)
SELECT user_id, event_type, round(CASE WHEN c = 1 THEN m ELSE a END, 4) AS mean, round(CASE WHEN c = 1 THEN s ELSE sqrt(greatest(q - a * a, 0)) END, 4) AS std FROM y""",
        "f16_quantise": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{HALF.format(x=f'({x})')} AS {n}" for x, n in (("l_extendedprice / 7", "price"), ("l_quantity * 1.37::DOUBLE", "quantity"), ("l_tax", "tax"))) + " FROM lineitem",
        "dedupe_first": _with("raw", "dd") + "SELECT gene, read, pos, round(mean, 6) AS mean, duration FROM dd",
        "stall_filter": _with(*e) + "SELECT gene, read, pos, round(mean, 6) AS mean FROM ev",
        "dict_encode": _with("raw", more=("o AS (SELECT gene, read, row_number() OVER (PARTITION BY gene ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, read) AS k FROM raw)", "f AS (SELECT gene, read, min(k) AS k FROM o GROUP BY ALL)")) + "SELECT gene, read, row_number() OVER (PARTITION BY gene ORDER BY k) - 1 AS idx FROM f",
        "kmer_last_wins": f"WITH {KMERS} SELECT * FROM km",
        "window_kmers": f"WITH {KMERS} SELECT b.gene, b.pos AS centre, a.kmer AS k0, b.kmer AS k1, c.kmer AS k2 FROM km a JOIN km b ON a.gene = b.gene AND a.pos = b.pos - 1 JOIN km c ON c.gene = b.gene AND c.pos = b.pos + 1",
        "shared_genes": _with(*e) + "SELECT gene FROM ev GROUP BY gene HAVING count(DISTINCT cond * 10 + rep) = 4",
        "shared_transcripts": _with(*e) + "SELECT gene, l_suppkey FROM ev WHERE cond = 0 INTERSECT SELECT gene, l_suppkey FROM ev WHERE cond = 1",
        "valid_positions": _with(*e, "vp") + "SELECT gene, pos FROM vp",
        "valid_windows": _with(*e, "vp", "vw") + "SELECT gene, centre FROM vw",
        "window_depth": _with(*v[:-1]) + "SELECT gene, centre, depth FROM deep",
        "window_vectors": _with(*v) + "SELECT gene, centre, cond, rep, read, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2 FROM vec",
        "pivot_matrix": _with(*e) + "SELECT gene, cond, rep, read, " + ", ".join(f"round(max(mean) FILTER (WHERE pos = {i}), 6) AS pos_{i}" for i in range(1, 8)) + " FROM ev GROUP BY ALL",
        "pooled_union": _with(*e) + "SELECT gene, pos, count(*) AS n, round(avg(mean), 5) AS mean FROM ev GROUP BY ALL",
        "topk_subsample": _with(*e) + "SELECT gene, cond, rep, read FROM (SELECT *, row_number() OVER (PARTITION BY gene, cond, rep ORDER BY (read * 2654435761) % 1000000007, read) AS k FROM (SELECT DISTINCT gene, cond, rep, read FROM ev)) WHERE k <= 20",
        "ks_2samp": ksp + "SELECT gene, pos, n0, n1, round(d, 6) AS d, round(p, 6) AS p FROM ks",
        "pca_comp1": pca + "SELECT gene, centre, cond, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS most FROM comp GROUP BY ALL",
        "pca_kstest": pks + "SELECT gene, centre, n0, n1, round(d, 4) AS d, round(p, 4) AS p FROM ks",
        "ks_gate": pks + "SELECT gene, centre, round(d, 4) AS d FROM ks WHERE d >= 0.2 AND p < 0.05",
        "mad": "SELECT event_type, round(med, 6) AS med, round(median(abs(value - med)), 6) AS mad FROM events JOIN (SELECT event_type, median(value) AS med FROM events GROUP BY event_type) USING (event_type) GROUP BY event_type, med",
        "dbscan_noise": """WITH x AS (SELECT event_type, event_id AS id, value AS x, (event_id % 97)::DOUBLE AS y FROM events),
near AS (SELECT a.event_type, a.id, b.id AS o FROM x a JOIN x b ON a.event_type = b.event_type AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 25),
core AS (SELECT n.id FROM near n JOIN (SELECT event_type, count(*) AS c FROM x GROUP BY event_type) s ON n.event_type = s.event_type GROUP BY n.id, s.c HAVING count(*) >= 0.004::DOUBLE * s.c)
SELECT event_type, id, id NOT IN (SELECT n.id FROM near n JOIN core ON n.o = core.id) AS noise FROM x""",
        "dbscan_core": """WITH x AS (SELECT event_type, event_id AS id, value AS x, (event_id % 97)::DOUBLE AS y FROM events),
near AS (SELECT a.event_type, a.id, b.id AS o FROM x a JOIN x b ON a.event_type = b.event_type AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 25),
core AS (SELECT n.id FROM near n JOIN (SELECT event_type, count(*) AS c FROM x GROUP BY event_type) s ON n.event_type = s.event_type GROUP BY n.id, s.c HAVING count(*) >= 0.004::DOUBLE * s.c)
SELECT event_type, id, id IN (SELECT id FROM core) AS core, id NOT IN (SELECT n.id FROM near n JOIN core ON n.o = core.id) AS noise FROM x""",
        "cluster_weights": _with(*e, more=(LABEL, WEIGHTS)) + "SELECT gene, pos, cond, rep, n, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM cw",
        "combined_weights": _with(*e, more=(LABEL, WEIGHTS)) + "SELECT gene, pos, " + ", ".join(f"round(sum(w{k} * n) / sum(n), 6) AS w{k}" for k in range(3)) + " FROM cw GROUP BY ALL",
        "gmm_init": _with(*v, more=(f"lv AS (SELECT *, CASE WHEN {mean3} < 65 THEN 0 WHEN {mean3} < 75 THEN 1 ELSE 2 END AS label FROM vec)",)) + "SELECT gene, centre, label, count(*) AS n, " + ", ".join([f"round(avg(v{i}), 4) AS m{i}" for i in range(3)] + [f"round(covar_pop(v{i}, v{j}), 4) AS c{i}{j}" for i in range(3) for j in range(i, 3)] + [f"round(min(v{i}), 4) AS low{i}" for i in range(3)] + [f"round(max(v{i}), 4) AS high{i}" for i in range(3)]) + " FROM lv GROUP BY ALL",
        "em_1d": _em(5),
        "em_windows": _em_windows(3),
        "posterior_1d": f"WITH x AS (SELECT event_id, {dens[0]} AS a, {dens[1]} AS b, {dens[2]} AS c FROM events) SELECT event_id, round(a / (a + b + c), 6) AS unmod, round(b / (a + b + c), 6) AS mod, round(c / (a + b + c), 6) AS outlier FROM x",
        "g_test_2x2": f"WITH {COUNTS}, gg AS (SELECT o_orderpriority, {het} AS g FROM cells) SELECT o_orderpriority, round(g, 6) AS g, round(CASE WHEN g = 0 THEN 1.0::DOUBLE ELSE {_chi2('g')} END, 6) AS p FROM gg",
        "g_test_hom": f"""WITH {COUNTS}, gg AS (SELECT o_orderpriority, {het} AS g, ({_g(reps('c'), False)}) + ({_g(reps('t'), False)}) AS hom FROM cells),
pp AS (SELECT *, CASE WHEN g = 0 THEN 1.0::DOUBLE ELSE {_chi2('g')} END AS p FROM gg)
SELECT o_orderpriority, round(g, 6) AS g, CASE WHEN p < 0.9::DOUBLE THEN round(hom, 6) END AS hom, round(CASE WHEN p < 0.9::DOUBLE AND hom >= g THEN 1.0::DOUBLE ELSE p END, 6) AS p FROM pp""",
        "log_odds": f"""WITH {COUNTS}, z AS (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5::DOUBLE ELSE 0 END AS s FROM cells),
y AS (SELECT *, ln((a + s) * (d + s) / ((b + s) * (c + s))) AS o, 1.959963984540054::DOUBLE * sqrt(1 / (a + s) + 1 / (b + s) + 1 / (c + s) + 1 / (d + s)) AS h FROM z)
SELECT o_orderpriority, round(b / (a + b), 6) AS cntrl_frac, round(d / (c + d), 6) AS treat_frac, round(o, 6) AS log_odds, round(o - h, 6) AS lower, round(o + h, 6) AS upper FROM y""",
        "bh_fdr": ksf + "SELECT gene, pos, round(p, 6) AS p, round(fdr, 6) AS fdr FROM fdr",
        "sig_filter": ksf + "SELECT gene, pos FROM fdr WHERE fdr < 0.05",
        "sm_semi_join": ksf + "SELECT gene, pos, cond, rep, read, round(mean, 6) AS mean FROM ev WHERE (gene, pos) IN (SELECT (gene, pos) FROM fdr WHERE fdr < 0.05)",
        "kmer_prior_join": f"WITH {KMERS}, {MODEL} SELECT gene, pos, km.kmer, level_mean FROM km JOIN md ON km.kmer = md.kmer",
        "kmer_shift": f"WITH {MODEL}, {SHIFTS} SELECT kmer, up FROM sh",
        "orient_components": f"WITH {MODEL}, {SHIFTS} SELECT id, flip FROM ori",
        "flip_results": f"""WITH {MODEL}, {SHIFTS}, x AS (SELECT p_partkey AS id, p_partkey::DOUBLE AS i, p_retailprice AS m1, p_size * 40.0::DOUBLE AS m2 FROM part)
SELECT x.id, flip, {swap('(i % 7) / 7', '1 - (i % 7) / 7')} AS cntrl_frac, {swap('(i % 11) / 11', '1 - (i % 11) / 11')} AS treat_frac, {swap('i % 13 - 6', '6 - i % 13')} AS log_odds,
{swap('i % 13 - 7', '4 - i % 13')} AS lower, {swap('i % 13 - 4', '7 - i % 13')} AS upper, {swap('m1', 'm2')} AS mu1, {swap('m2', 'm1')} AS mu2, {swap('i % 3', 'i % 5')} AS sd1, {swap('i % 5', 'i % 3')} AS sd2 FROM x JOIN ori ON x.id = ori.id""",
        "bed_format": _with(*e, more=(_ks("ev", "gene, pos", "mean").replace(" AS p FROM xx)", " AS p0 FROM xx)").replace("ks AS (SELECT *,", "ks0 AS (SELECT *,"), "ks AS (SELECT gene, pos, d, round(p0, 8) AS p FROM ks0)", FDR))
        + f"""SELECT concat_ws(chr(9), 'chr' || gene, pos - 2, pos + 3, gene || ':ACGTA', round_even(least(CASE WHEN fdr > 0 THEN -log10(fdr) ELSE 100 END, 100), 0)::INT, CASE WHEN gene % 2 = 0 THEN '+' ELSE '-' END,
  {two(gn(13) + ' / 4')} || '[' || {two(gn(13) + ' / 4 - 1')} || ',' || {two(gn(13) + ' / 4 + 1')} || ']', format('{{:.2g}}', p), format('{{:.2g}}', fdr), {two(gn(7) + ' / 7')}, {two(gn(5) + ' / 5')}, {two(gn(19))},
  CASE WHEN {gn(2)} = 0 THEN {two(gn(3))} ELSE 'nan' END, {two(gn(40) + ' + 60')}, {two(gn(9) + ' / 4')}, {two(gn(40) + ' + 70')}, {two(gn(11) + ' / 4')}, {two('floor(d * 4) / 4')}) AS line FROM fdr""",
        "cigar_max_indel": f"WITH {CIGAR} SELECT l_orderkey, l_partkey, l_linenumber, list_max(gaps)::INT AS max_indel, list_max(gaps[1:2])::INT AS without_skips FROM al",
        "aln_filter": f"""WITH {CIGAR} SELECT l_orderkey, l_partkey, l_linenumber FROM al WHERE q * 15 >= 100
AND (q * 15)::DOUBLE / (CASE WHEN l_orderkey % 5 = 0 THEN q * 16 ELSE q * 15 + l_partkey % 60 END) >= 0.85::DOUBLE AND l_discount * 2 <= 0.15::DOUBLE AND l_suppkey % 4 >= 1 AND list_max(gaps) <= 15""",
        "gene_dim_join": _with(*e) + "SELECT gene, count(*) AS n, r_name AS chrom FROM ev JOIN region ON gene = r_regionkey WHERE cond = 0 AND rep = 1 GROUP BY ALL",
        "gene_subset": _with(*e) + "SELECT gene, pos, count(*) AS n FROM ev WHERE gene IN (1, 3) GROUP BY ALL",
        "store_encoded": _with("raw", "dd") + f"SELECT 'c' || cond AS sample, gene::VARCHAR AS gene_id, pos, count(*) AS n, round(avg({HALF.format(x='mean')}), 4) AS mean, round(avg({HALF.format(x='(duration)')}), 4) AS duration FROM dd GROUP BY ALL",
        "store_roundtrip": _with(*e) + f"SELECT cond || '-' || rep AS sample, gene AS gene_id, pos, count(*) AS n, round(avg({HALF.format(x='mean')}), 4) AS mean FROM ev GROUP BY ALL",
    }
