"""The chunk graph: edges, neighbourhoods, chains, transitions and predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import graph as G
from tessera.operators import teams as TE
from tessera.operators import vector_search as VS
from tessera.operators.components import connected_components
from tessera.plans.registry import Registry
from tessera.plans.texts import _TRIM, _USER, PLANTED_SQL, planted, q
from tessera.runtime import broadcast_if_small, key_of, materialise, read_table
from tessera.sources import store as S
from tessera.sources.store import K
from tessera.sources.store import prelude as P

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_CAUSAL = f"""tu AS (SELECT id, session_id, start_time, end_time, regexp_matches({_TRIM.format(_USER)}, {q(X.TOPIC_SHIFT)}) AS shift, unnest(list_distinct(turn_indices)) AS turn FROM c),
tt AS (SELECT * FROM tu WHERE turn IS NOT NULL AND session_id IS NOT NULL),
wi AS (SELECT id AS src, lead(id) OVER (PARTITION BY session_id, turn ORDER BY start_time, id) AS dst FROM tt),
fr AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY start_time, id) AS f, row_number() OVER (PARTITION BY session_id, turn ORDER BY start_time DESC, id DESC) AS l FROM tt),
en AS (SELECT a.session_id, a.turn, a.id AS fid, a.start_time AS fstart, a.shift, b.id AS lid, b.end_time AS lend FROM fr a JOIN fr b ON a.session_id = b.session_id AND a.turn = b.turn AND a.f = 1 AND b.l = 1),
ac AS (SELECT lid AS src, lead(fid) OVER w AS dst, epoch_us(lead(fstart) OVER w) - epoch_us(lend) AS gap, lead(shift) OVER w AS shift FROM en WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
ce AS (SELECT DISTINCT src, dst FROM (SELECT * FROM wi UNION ALL SELECT src, dst FROM ac WHERE coalesce(gap <= 1800000000, true) AND NOT coalesce(shift, false)) WHERE dst IS NOT NULL AND src <> dst)"""


@register(f"WITH {P('c')}, {_CAUSAL} SELECT * FROM ce")
def causal_edges(spark, d):
    return G.causal_edges(S.chunks(spark, d))


@register(f"WITH {P('c')}, {_CAUSAL} SELECT 'edge-' || substr(sha256(src || ':' || dst || ':within-chain'), 1, 16) AS id, src, dst, 'forward' AS edge_type, 'within-chain' AS reference_type, 1.0::DOUBLE AS weight, 1 AS link_count FROM ce")
def rebuilt_edge_rows(spark, d):
    return G.materialise_edges(G.causal_edges(S.chunks(spark, d)), "within-chain")


_ENDS = f"""se AS (SELECT session_slug, session_id, min(start_time) AS started, arg_min(id, (start_time, id)) AS first_id, arg_min(regexp_matches(content, {q(X.RESUMED)}), (start_time, id)) AS resumed, arg_max(id, (start_time, id)) AS last_id FROM c GROUP BY 1, 2),
sl AS (SELECT lag(last_id) OVER (PARTITION BY session_slug ORDER BY started, session_id) AS src, first_id AS dst, resumed FROM se)"""


@register(f"WITH {P('c')}, {_ENDS} SELECT src, dst FROM sl WHERE src IS NOT NULL")
def cross_session_edges(spark, d):
    return G.session_links(S.chunks(spark, d))


@register(f"WITH {P('c')}, {_ENDS} SELECT src, dst FROM sl WHERE src IS NOT NULL AND resumed")
def resumed_session_edges(spark, d):
    return G.session_links(S.chunks(spark, d), only_resumed=True)


@register(f"WITH {PLANTED_SQL}, {_ENDS} SELECT src, dst FROM sl WHERE src IS NOT NULL AND resumed")
def resumed_session_edges_planted(spark, d):
    return G.session_links(planted(spark, d), only_resumed=True)


_LINES = f"l AS (SELECT {K.format('uuid')} AS uuid, min({K.format('parentUuid')}) AS parent, min({K.format('sessionId')}) AS session, min(agentId) AS agent, min(ingested_at) AS ing FROM sample_session WHERE {K.format('uuid')} IS NOT NULL GROUP BY 1)"


@register(f"""WITH {_LINES}, a AS (SELECT session, agent, count(*) AS n, arg_min(uuid, (ing, uuid)) AS first_uuid, arg_max(uuid, (ing, uuid)) AS last_uuid FROM l WHERE agent IS NOT NULL GROUP BY 1, 2),
b AS (SELECT l.agent, l.session, min(p.uuid) AS spawned_by FROM l JOIN l p ON l.parent = p.uuid AND l.session = p.session AND p.agent IS NULL WHERE l.agent IS NOT NULL GROUP BY 1, 2),
r AS (SELECT p.agent, p.session, min(l.uuid) AS reported_to FROM l JOIN l p ON l.parent = p.uuid AND l.session = p.session AND p.agent IS NOT NULL WHERE l.agent IS NULL GROUP BY 1, 2)
SELECT a.session, a.agent, n, first_uuid, last_uuid, spawned_by, reported_to FROM a LEFT JOIN b ON a.agent = b.agent AND a.session = b.session LEFT JOIN r ON a.agent = r.agent AND a.session = r.session""")
def agent_brief_debrief(spark, d):
    """Per sub-agent its lines, the main line that briefed it and the main line that it reported to."""
    raw = read_table(spark, d, "sample_session").select(key_of("uuid").alias("uuid"), key_of("parentUuid").alias("parent"), key_of("sessionId").alias("session"), F.col("agentId").alias("agent"), "ingested_at")
    l = raw.filter("uuid is not null").groupBy("uuid").agg(F.min("parent").alias("parent"), F.min("session").alias("session"), F.min("agent").alias("agent"), F.min("ingested_at").alias("ing"))
    p = l.select(F.col("uuid").alias("parent"), F.col("session"), F.col("agent").alias("p_agent"))
    links = l.join(p, ["parent", "session"])
    at = F.struct("ing", "uuid")
    a = l.filter("agent is not null").groupBy("session", "agent").agg(F.count("*").alias("n"), F.min_by("uuid", at).alias("first_uuid"), F.max_by("uuid", at).alias("last_uuid"))
    brief = links.filter("agent is not null and p_agent is null").groupBy("agent", "session").agg(F.min("parent").alias("spawned_by"))
    report = links.filter("agent is null and p_agent is not null").groupBy(F.col("p_agent").alias("agent"), "session").agg(F.min("uuid").alias("reported_to"))
    return a.join(brief, ["agent", "session"], "left").join(report, ["agent", "session"], "left").select("session", "agent", "n", "first_uuid", "last_uuid", "spawned_by", "reported_to")


@register(f"WITH {P('c')} SELECT team_name, session_id, count(DISTINCT agent_id) AS n_agents, count(*) AS n_chunks, arg_min(id, (start_time, id)) AS first_id FROM c WHERE team_name IS NOT NULL GROUP BY 1, 2")
def team_topology(spark, d):
    c = S.chunks(spark, d).filter("team_name is not null")
    return c.groupBy("team_name", "session_id").agg(F.countDistinct("agent_id").alias("n_agents"), F.count("*").alias("n_chunks"), F.min_by("id", F.struct("start_time", "id")).alias("first_id"))


@register(f"""WITH {P('c')}, l AS (SELECT session_id, id, start_time FROM c WHERE agent_id IS NULL), f AS (SELECT session_id, agent_id, min(start_time) AS t, arg_min(id, (start_time, id)) AS dst FROM c WHERE agent_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2)
SELECT f.session_id, agent_id, arg_max(l.id, (l.start_time, l.id)) AS src, dst, 0.9::DOUBLE AS weight FROM f JOIN l ON f.session_id = l.session_id AND l.start_time <= t GROUP BY 1, 2, 4""")
def team_edges(spark, d):
    """Spawn edges as far as stored chunks tell: the lead's last chunk before an agent's first one, to that."""
    c = S.chunks(spark, d).filter("session_id is not null").select(F.col("session_id").alias("session"), F.col("agent_id").alias("agent"), "id", F.col("start_time").alias("start"))
    return TE.first_contacts(c).select(F.col("session").alias("session_id"), F.col("agent").alias("agent_id"), "src", "dst", F.lit(G.WEIGHTS["team-spawn"]).alias("weight"))


@register(f"WITH {P('e')} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def graph_degree(spark, d):
    return G.degrees(S.edges(spark, d))


_SEEDS = "sd AS (SELECT id FROM c WHERE id IN (SELECT src FROM fe) ORDER BY id LIMIT 5)"


def _stated(spark, d):
    """The stated query set of the measures over walks: the chunks whose id's hash is divisible by 50, linked or not."""
    return S.chunks(spark, d).filter(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 50 == 0).select("id")


_STATED_SEEDS = "sd AS (SELECT id FROM c WHERE CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 50 = 0)"


def _seeds(spark, d, n=5):
    e = S.forward_edges(spark, d)
    return S.chunks(spark, d).select("id").join(e.select(F.col("src").alias("id")), "id", "left_semi").orderBy("id").limit(n)


@register(f"""WITH RECURSIVE {P('fe')}, {_SEEDS}, b AS (SELECT src, dst FROM fe UNION SELECT dst, src FROM fe), n(id, hop) AS (SELECT id, 0 FROM sd UNION SELECT b.dst, n.hop + 1 FROM n JOIN b ON b.src = n.id WHERE n.hop < 3),
m AS (SELECT id, min(hop) AS hop FROM n GROUP BY 1) SELECT m.id, hop, (SELECT count(*) FROM b WHERE b.src = m.id AND b.dst IN (SELECT id FROM m)) AS degree FROM m""")
def bfs_neighborhood(spark, d):
    """Everything within 3 hops of the seeds, with the degree inside."""
    e = materialise(S.forward_edges(spark, d), "edges")
    n = G.neighbourhood(e, _seeds(spark, d), 3)
    both = e.select("src", "dst").union(e.select("dst", "src")).distinct()
    n = materialise(n, "reached")
    inner = both.join(broadcast_if_small(n.select(F.col("id").alias("src"))), "src").join(broadcast_if_small(n.select(F.col("id").alias("dst"))), "dst", "left_semi")
    deg = inner.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return n.join(deg, "id", "left").select("id", "hop", F.coalesce("degree", F.lit(0)).alias("degree"))


def _walk_sql(src: str, dst: str, seeds: str = _SEEDS) -> str:
    return f"""WITH RECURSIVE {P('fe')}, {seeds}, w(seed, node, path) AS (SELECT id, id, [id] FROM sd UNION ALL SELECT w.seed, fe.{dst}, list_append(w.path, fe.{dst}) FROM w JOIN fe ON fe.{src} = w.node WHERE NOT list_contains(w.path, fe.{dst}) AND len(w.path) <= 5),
p AS (SELECT seed, path FROM w WHERE len(path) = 6 OR NOT EXISTS (SELECT 1 FROM fe WHERE fe.{src} = w.node AND NOT list_contains(w.path, fe.{dst})))"""


@register(_walk_sql("src", "dst") + " SELECT seed, path FROM p")
def chain_walk_forward(spark, d):
    return G.walk_paths(S.forward_edges(spark, d), _seeds(spark, d), 5)


@register(_walk_sql("dst", "src") + " SELECT seed, path FROM p")
def chain_walk_backward(spark, d):
    e = S.forward_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.walk_paths(e, _seeds(spark, d), 5)


@register()
def chain_walk_budgeted(spark, d):
    """The walk with a token budget and a limit on the open paths per seed."""
    nodes = S.chunks(spark, d).select("id", F.col("approx_tokens").alias("tokens"))
    return G.walk_paths(S.forward_edges(spark, d), _seeds(spark, d), 12, nodes, budget=6000, per_seed=10)


_BEST = f"""{_walk_sql('src', 'dst')}, {P('v')}, qv AS (SELECT embedding AS q FROM v ORDER BY id LIMIT 1), sc AS (SELECT id, 1 - acos(greatest(-1, least(1, list_cosine_similarity(embedding, q)))) / pi() AS s FROM v, qv),
nd AS (SELECT seed, path, unnest(path) AS id FROM p WHERE len(path) >= 2), md AS (SELECT seed, path, round(median(coalesce(s, 0)), 6) AS median FROM nd LEFT JOIN sc ON nd.id = sc.id GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY median DESC, len(path) DESC, path) AS r FROM md)"""


@register(f"{_BEST} SELECT seed, path, median FROM rk WHERE r = 1")
def best_chain(spark, d):
    v = S.search_vectors(spark, d)
    r = v.orderBy("id").select("embedding").first()
    query = F.array(*[F.lit(float(x)) for x in (r.embedding if r else [0.0])])
    scores = v.select("id", (1 - V.angular(F.col("embedding"), query)).alias("score"))
    paths = G.walk_paths(S.forward_edges(spark, d), _seeds(spark, d), 5)
    best = G.best_paths(paths, scores.withColumn("score", F.round("score", 12)))
    return best.withColumn("median", F.round("median", 6))


@register(f"""WITH RECURSIVE {P('fe')}, {_SEEDS}, w(seed, node, path) AS (SELECT id, id, [id] FROM sd UNION ALL SELECT seed, nx, list_append(path, nx) FROM (SELECT seed, path, (SELECT min(dst) FROM fe WHERE src = w.node AND NOT list_contains(w.path, dst)) AS nx FROM w WHERE len(path) <= 20) WHERE nx IS NOT NULL)
SELECT seed, arg_max(path, len(path)) AS path FROM w GROUP BY seed""")
def structural_walk(spark, d):
    return G.first_walk(S.forward_edges(spark, d), _seeds(spark, d), 20)


@register()
def chain_candidates(spark, d):
    """Candidate chains of the stated queries by depth-first walks with all their limits: a budget of 2,000 tokens, larger
    chunks and those of sub-agents passed through."""
    n = S.chunks(spark, d).select("id", F.col("approx_tokens").alias("tokens"), F.coalesce("agent_id", F.lit("main")).alias("agent"), F.lit(0.0).alias("score"))
    return G.walk_chains(S.forward_edges(spark, d), n, _stated(spark, d), 2000, agent="main")


@register(f"WITH {P('fe', 'k')}, dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM fe UNION ALL SELECT dst FROM fe) GROUP BY 1), x AS (SELECT DISTINCT lower(trim(unnest(exemplar_ids), E' \\t\\n\\r')) AS id FROM k) SELECT dg.id, degree, dg.id IN (SELECT id FROM x WHERE id <> '') AS exemplar FROM dg ORDER BY exemplar DESC, degree DESC, dg.id LIMIT 100")
def sampled_graph(spark, d):
    """The 100 most important nodes: exemplars first, then by degree."""
    x = S.clusters(spark, d).select(F.explode("exemplar_ids").alias("x")).select(key_of("x").alias("id")).filter("id is not null").distinct().withColumn("exemplar", F.lit(True))
    g = G.degrees(S.forward_edges(spark, d)).join(x, "id", "left").select("id", "degree", F.coalesce("exemplar", F.lit(False)).alias("exemplar"))
    return g.orderBy(F.desc("exemplar"), F.desc("degree"), "id").limit(100)


_PRIMARY = "pc AS (SELECT chunk_id AS id, cluster_id AS label FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(distance, 1), cluster_id) AS r FROM a) WHERE r = 1)"


def _primary(spark, d):
    best = F.min(F.struct(F.coalesce("distance", F.lit(1.0)).alias("d"), "cluster_id"))
    return S.chunk_clusters(spark, d).groupBy(F.col("chunk_id").alias("id")).agg(best.alias("b")).select("id", F.col("b.cluster_id").alias("label"))


@register(f"WITH {P('c', 'fe', 'a')}, {_PRIMARY}, t AS (SELECT c.id, start_time, session_slug, label FROM c LEFT JOIN pc ON c.id = pc.id WHERE start_time >= TIMESTAMPTZ '2024-06-01 00:00:00+00' AND start_time < TIMESTAMPTZ '2024-09-01 00:00:00+00') SELECT id, start_time, label, (SELECT count(*) FROM fe WHERE src = t.id AND dst IN (SELECT id FROM t)) AS n_links FROM t")
def timeline(spark, d):
    """A time range with each chunk's cluster and its links within the range."""
    t = S.chunks(spark, d).filter((F.col("start_time") >= F.lit("2024-06-01").cast("timestamp")) & (F.col("start_time") < F.lit("2024-09-01").cast("timestamp"))).select("id", "start_time").join(_primary(spark, d), "id", "left")
    inner = S.forward_edges(spark, d).join(t.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_links"))
    return t.join(inner, "id", "left").select("id", "start_time", "label", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@register(f"WITH {P('fe', 'a')}, {_PRIMARY}, n AS (SELECT x.label AS src_label, y.label AS dst_label, count(*) AS n FROM fe JOIN pc x ON fe.src = x.id JOIN pc y ON fe.dst = y.id GROUP BY 1, 2) SELECT src_label, dst_label, n, round(n / sum(n) OVER (PARTITION BY src_label), 6) AS share FROM n")
def transition_matrix(spark, d):
    return G.transitions(S.forward_edges(spark, d), _primary(spark, d)).withColumn("share", F.round("share", 6))


@register(f"WITH {P('fe', 'a', 'c')}, {_PRIMARY}, n AS (SELECT c.session_slug, x.label AS src_label, y.label AS dst_label, count(*) AS n FROM fe JOIN c ON c.id = fe.src JOIN pc x ON fe.src = x.id JOIN pc y ON fe.dst = y.id GROUP BY 1, 2, 3) SELECT *, round(n / sum(n) OVER (PARTITION BY session_slug, src_label), 6) AS share FROM n")
def project_conditioned(spark, d):
    """Transitions within each project."""
    e = S.forward_edges(spark, d).join(S.chunks(spark, d).select(F.col("id").alias("src"), "session_slug"), "src")
    p = _primary(spark, d)
    j = e.join(p.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(p.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    n = j.groupBy("session_slug", "src_label", "dst_label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("session_slug", "src_label")), 6))


_SEQ = f"{_PRIMARY}, sq AS (SELECT c.id, c.session_id, c.start_time, label FROM c JOIN pc ON c.id = pc.id), tg AS (SELECT id, label AS a, lead(label) OVER w AS b, lead(label, 2) OVER w AS z FROM sq WINDOW w AS (PARTITION BY session_id ORDER BY start_time, id))"


def _trigrams(spark, d):
    w = Window.partitionBy("session_id").orderBy("start_time", "id")
    s = S.chunks(spark, d).select("id", "session_id", "start_time").join(_primary(spark, d), "id")
    return s.select("id", F.col("label").alias("a"), F.lead("label").over(w).alias("b"), F.lead("label", 2).over(w).alias("z"))


@register(f"WITH {P('c', 'a')}, {_SEQ}, t3 AS (SELECT a, b, z, count(*) AS n FROM tg WHERE z IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, z) AS rank FROM t3) SELECT a, b, z AS predicted, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def trigram_predict(spark, d):
    """The 5 most likely next clusters after each pair of clusters in a session."""
    t = _trigrams(spark, d).filter("z is not null").groupBy("a", "b", "z").agg(F.count("*").alias("n"))
    w = Window.partitionBy("a", "b").orderBy(F.desc("n"), "z")
    return t.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("a", "b", F.col("z").alias("predicted"), "n", "rank")


@register(f"""WITH {P('c', 'a')}, {_SEQ}, bi AS (SELECT a, b, count(*) AS n FROM tg WHERE b IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM bi), po AS (SELECT b, row_number() OVER (ORDER BY count(*) DESC, b) AS rank FROM tg WHERE b IS NOT NULL GROUP BY 1), te AS (SELECT a, b FROM tg WHERE b IS NOT NULL)
SELECT (SELECT count(*) FROM te) AS n, round((SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.a = te.a AND r.b = te.b AND rank <= 5) THEN 1.0 ELSE 0.0 END) FROM te), 6) AS bigram_hits, round((SELECT avg(CASE WHEN te.b IN (SELECT b FROM po WHERE rank <= 5) THEN 1.0 ELSE 0.0 END) FROM te), 6) AS popular_hits""")
def precision_recall_lift(spark, d):
    """Share of next clusters among the 5 predicted by bigrams, and by mere popularity."""
    t = _trigrams(spark, d).filter("b is not null").select("a", "b")
    bi = G.top_per(t.groupBy("a", "b").agg(F.count("*").alias("n")), "a", 5, F.desc("n"), F.col("b")).select("a", "b", F.lit(1.0).alias("hit"))
    po = F.broadcast(t.groupBy("b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "b").limit(5).select("b", F.lit(1.0).alias("pop")))
    j = t.join(bi, ["a", "b"], "left").join(po, "b", "left").na.fill(0.0, ["hit", "pop"])
    return j.agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("bigram_hits"), F.round(F.avg("pop"), 6).alias("popular_hits"))


def _added_sql(a: str, b: str, name: str) -> str:
    return f"""{name}(seed, node, path) AS (SELECT id, id, [id] FROM sd UNION ALL SELECT {name}.seed, fe.{b}, list_append({name}.path, fe.{b}) FROM {name} JOIN fe ON fe.{a} = {name}.node WHERE NOT list_contains({name}.path, fe.{b}) AND len({name}.path) <= 3)"""


@register(f"""WITH RECURSIVE {P('fe', 'v')}, {_STATED_SEEDS}, {_added_sql('src', 'dst', 'fw')}, {_added_sql('dst', 'src', 'bw')},
re AS (SELECT DISTINCT seed, node FROM (SELECT * FROM fw UNION ALL SELECT * FROM bw)),
cs AS (SELECT sd.id AS seed, x.id, row_number() OVER (PARTITION BY sd.id ORDER BY round(acos(greatest(-1, least(1, list_cosine_similarity(q.embedding, x.embedding)))) / pi(), 6), x.id) AS r FROM sd JOIN v q ON q.id = sd.id JOIN v x ON x.id <> sd.id),
nh AS (SELECT seed, id AS node FROM cs WHERE r <= 5),
g AS (SELECT sd.id, (SELECT count(*) FROM nh WHERE nh.seed = sd.id) AS n_vector, (SELECT count(*) FROM re WHERE re.seed = sd.id AND re.node <> sd.id AND NOT EXISTS (SELECT 1 FROM nh WHERE nh.seed = sd.id AND nh.node = re.node)) AS n_added FROM sd)
SELECT count(*) AS n_seeds, CAST(sum(n_vector) AS BIGINT) AS n_vector, CAST(sum(n_added) AS BIGINT) AS n_added, round(sum(n_vector + n_added) / nullif(sum(n_vector), 0), 6) AS augmentation FROM g""")
def chain_augmentation(spark, d):
    """What walks of 3 links, forward and backward, add to the 5 nearest vectors, over the stated query set."""
    seeds = materialise(_stated(spark, d), "stated")
    e = materialise(S.forward_edges(spark, d), "edges")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    walked = G.walk_paths(e, seeds, 3).unionByName(G.walk_paths(back, seeds, 3)).select("seed", F.explode("path").alias("id")).distinct().filter("id <> seed")
    v = S.search_vectors(spark, d).select("id", "embedding")
    near = materialise(VS.knn_join(v.join(broadcast_if_small(seeds), "id", "left_semi"), v, 5).select(F.col("qid").alias("seed"), "id"), "near")
    added = walked.join(near, ["seed", "id"], "left_anti").agg(F.count("*").alias("n_added"))
    out = seeds.agg(F.count("*").alias("n_seeds")).join(near.agg(F.count("*").alias("n_vector"))).join(added)
    return out.select("n_seeds", "n_vector", "n_added", F.round(F.try_divide(F.col("n_vector") + F.col("n_added"), F.col("n_vector")), 6).alias("augmentation"))


@register(f"WITH RECURSIVE {P('fe')}, b AS (SELECT src, dst FROM fe UNION SELECT dst, src FROM fe), r(node, other) AS (SELECT DISTINCT src, src FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.other = b.src) SELECT node, min(other) AS component FROM r GROUP BY 1")
def graph_components(spark, d):
    return connected_components(S.forward_edges(spark, d))
