"""Text features of chunks and documents: markers, overlaps, entities, redaction, previews, hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.ranking import rank_within
from tessera.plans.registry import Registry
from tessera.runtime import broadcast_if_small, materialise, read_table
from tessera.sources import store as S
from tessera.sources.store import prelude as P

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_USER = f"regexp_extract(content, {q(X.USER_BLOCK)}, 1)"


@register(f"WITH {P('c')} SELECT id, regexp_matches({_TRIM.format(_USER)}, {q(X.TOPIC_SHIFT)}) AS shift, regexp_matches({_TRIM.format(_USER)}, {q(X.CONTINUATION)}) AS continuation, regexp_matches(content, {q(X.RESUMED)}) AS resumed FROM c")
def topic_markers(spark, d):
    u = X.user_text(F.col("content"))
    return S.chunks(spark, d).select("id", X.has_topic_shift(u).alias("shift"), X.has_continuation(u).alias("continuation"), X.is_resumed(F.col("content")).alias("resumed"))


@register(f"WITH {P('c')} SELECT id, {_USER} AS user_text FROM c")
def chunk_user_text(spark, d):
    return S.chunks(spark, d).select("id", X.user_text(F.col("content")).alias("user_text"))


_PATHS = f"list_distinct(list_transform(list_concat(regexp_extract_all({{0}}, {q(X.FILE_PATH)}, 1), regexp_extract_all({{0}}, {q(X.DIR_PATH)}, 1)), lambda p: lower(regexp_replace(p, '^\\./', ''))))"


@register(f"WITH {P('c')} SELECT id, list_sort({_PATHS.format('content')}) AS paths FROM c")
def chunk_paths(spark, d):
    return S.chunks(spark, d).select("id", F.array_sort(X.paths(F.col("content"))).alias("paths"))


_STOP = "[" + ", ".join(q(w) for w in X.STOP_WORDS) + "]"
_KEYS = f"list_distinct(list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w) AND NOT regexp_matches(w, '^[0-9]+$')))"
_JACCARD = "coalesce(len(list_intersect({0}, {1})) / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0.0)"


@register(f"""WITH {P('c')}, t AS (SELECT id, {_KEYS.format('content')} AS k, {_PATHS.format('content')} AS p, session_id, start_time FROM c),
n AS (SELECT id, k, p, lag(id) OVER w AS previous, lag(k) OVER w AS pk, lag(p) OVER w AS pp FROM t WINDOW w AS (PARTITION BY session_id ORDER BY start_time, id))
SELECT id, previous, round({_JACCARD.format('k', 'pk')}, 6) AS keyword_overlap, round({_JACCARD.format('p', 'pp')}, 6) AS path_overlap FROM n WHERE previous IS NOT NULL""")
def keyword_overlap(spark, d):
    """Keyword and path overlap of each chunk with the one before it in its session."""
    t = S.chunks(spark, d).select("id", "session_id", "start_time", X.keywords(F.col("content")).alias("k"), X.paths(F.col("content")).alias("p"))
    w = Window.partitionBy("session_id").orderBy("start_time", "id")
    n = t.select("id", "k", "p", F.lag("id").over(w).alias("previous"), F.lag("k").over(w).alias("pk"), F.lag("p").over(w).alias("pp")).filter("previous is not null")
    return n.select("id", "previous", F.round(X.jaccard(F.col("k"), F.col("pk")), 6).alias("keyword_overlap"), F.round(X.jaccard(F.col("p"), F.col("pp")), 6).alias("path_overlap"))


def _entity_rows(chunks):
    return chunks.select("id", "session_slug", "start_time", F.explode(X.entities(X.relevant_text(F.col("content")))).alias("e")).select("id", "session_slug", "start_time", "e.*")


_BLOCK = "[" + ", ".join(q(w) for w in X.NO_NAMES) + "]"
_REL = r"""CASE WHEN contains(content, '[User]') OR contains(content, '[Assistant]') THEN regexp_replace(regexp_replace(regexp_replace(content, '(?s)\[Thinking\].*?(?:(\[User\]|\[Assistant\])|\z)', '\1', 'g'), '(?s)\A.*?(\[User\]|\[Assistant\])', '\1'), '\[(?:User|Assistant)\]', '', 'g') ELSE content END"""
_ENT = f"""t AS (SELECT id, session_slug, start_time, regexp_replace({_REL}, {q(X.FENCED)}, '', 'g') AS t FROM c),
m AS (
  SELECT id, 1 AS o, 'person' AS entity_type, '@' || m AS mention_form, lower(m) AS name, 0.95 AS confidence, i FROM (SELECT id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, {q(X.MENTION)}, 1) AS x FROM t))
  UNION ALL SELECT id, 2, 'channel', '#' || m, lower(m), 0.95, i FROM (SELECT id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, {q(X.CHANNEL)}, 1) AS x FROM t)) WHERE NOT regexp_matches(lower(m), '^[0-9a-f]{{3,8}}$')
  UNION ALL SELECT id, 3, 'person', m, lower(m), 0.9, i FROM (SELECT id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, {q(X.EMAIL)}) AS x FROM t))
  UNION ALL SELECT id, 4, 'url', m, m, 1.0, i FROM (SELECT id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, {q(X.URL)}) AS x FROM t))
  UNION ALL SELECT id, 5, 'person', m, lower(m), 0.6, i FROM (SELECT id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, {q(X.SAID)}, 1) AS x FROM t)) WHERE NOT list_has_any(regexp_split_to_array(lower(m), '\\s+'), {_BLOCK})
  UNION ALL SELECT id, 6, 'person', m, lower(m), 0.6, i FROM (SELECT id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, {q(X.WITH_FROM)}, 1) AS x FROM t)) WHERE NOT list_has_any(regexp_split_to_array(lower(m), '\\s+'), {_BLOCK})
  UNION ALL SELECT id, 7, 'meeting', m, regexp_replace(lower(m), '\\s+', '-', 'g'), 0.7, i FROM (SELECT id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(t, {q(X.MEETING)}, 1) AS x FROM t))),
r AS (SELECT *, row_number() OVER (PARTITION BY id, entity_type, name ORDER BY o, i) AS r FROM m),
en AS (SELECT r.id, entity_type, mention_form, name, CAST(confidence AS DOUBLE) AS confidence, session_slug, start_time FROM r JOIN t ON r.id = t.id WHERE r = 1)"""


@register(f"WITH {P('c')}, {_ENT} SELECT id, entity_type, mention_form, name, confidence FROM en")
def entities(spark, d):
    return _entity_rows(S.chunks(spark, d)).select("id", "entity_type", "mention_form", "name", "confidence")


@register(f"WITH {P('c')}, {_ENT} SELECT entity_type, name, session_slug, substr(sha256(session_slug || ':' || entity_type || ':' || name), 1, 16) AS entity_id, count(DISTINCT mention_form) AS n_forms, count(DISTINCT id) AS n_chunks FROM en GROUP BY 1, 2, 3")
def entity_resolution(spark, d):
    """Entities per project with a deterministic id; every spelling is an alias."""
    return _entity_rows(S.chunks(spark, d)).groupBy("entity_type", "name", "session_slug").agg(F.countDistinct("mention_form").alias("n_forms"), F.countDistinct("id").alias("n_chunks")).withColumn("entity_id", X.short_hash(F.concat_ws(":", "session_slug", "entity_type", "name"), 16))


@register(f"WITH {P('c')}, {_ENT}, x AS (SELECT entity_type, name, id, row_number() OVER (PARTITION BY entity_type, name ORDER BY start_time DESC, id) AS r FROM en) SELECT entity_type, name, id, r FROM x WHERE r <= 100")
def entity_lookup(spark, d):
    """The newest chunks of each entity, 100 at most."""
    w = Window.partitionBy("entity_type", "name").orderBy(F.desc("start_time"), "id")
    return _entity_rows(S.chunks(spark, d)).withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 100").select("entity_type", "name", "id", "r")


@register(f"WITH {P('c')} SELECT id, md5(regexp_replace(regexp_replace(content, {q(X.ABSOLUTE_PATH)}, '[REDACTED_PATH]', 'g'), {q(X.FENCED)}, E'```\\n[REDACTED_CODE]\\n```', 'g')) AS redacted, CAST((length(content) - length(replace(content, '```', ''))) // 6 AS INTEGER) AS n_code_blocks FROM c")
def code_and_path_redaction(spark, d):
    return S.chunks(spark, d).select("id", F.md5(X.redact_code(X.redact_paths(F.col("content")))).alias("redacted"), X.code_blocks(F.col("content")).alias("n_code_blocks"))


_BP = "content"
for _b in X.BOILERPLATE:
    _BP = f"regexp_replace({_BP}, {q(_b)}, '', 'g')"


@register(f"WITH {P('c')} SELECT id, md5({_TRIM.format(f'''regexp_replace({_BP}, E'\\n{{3,}}', E'\\n\\n', 'g')''')}) AS stripped, md5(substr(content, 1, 1792)) AS truncated FROM c")
def boilerplate_variants(spark, d):
    t = F.col("content")
    return S.chunks(spark, d).select("id", F.md5(X.without_boilerplate(t)).alias("stripped"), F.md5(F.substring(t, 1, 1792)).alias("truncated"))


@register("SELECT sha256(text) AS content_hash, substr(sha256(text), 1, 8) AS query_hash, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def near_dup_hash(spark, d):
    """Equal texts by content hash."""
    t = read_table(spark, d, "documents").filter("text is not null")
    return t.groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n")).filter("n > 1").withColumn("query_hash", F.substring("content_hash", 1, 8))


@register(f"WITH {P('c')} SELECT id, session_id || '-' || substr(sha256(session_id || ':' || array_to_string(turn_indices, ',') || ':' || content), 1, 16) AS chunk_id FROM c WHERE turn_indices IS NOT NULL")
def deterministic_chunk_ids(spark, d):
    return S.chunks(spark, d).filter("turn_indices is not null").select("id", X.chunk_id(F.col("session_id"), F.col("turn_indices"), F.col("content")).alias("chunk_id"))


@register(f"""WITH {P('c')}, t AS (SELECT id, CAST(epoch_ms(end_time) - epoch_ms(start_time) AS DOUBLE) AS ms, greatest(0, epoch_us(TIMESTAMPTZ '2026-02-01 00:00:00+00') // 1000000 - epoch_us(start_time) // 1000000) AS s FROM c)
SELECT id, CASE WHEN ms < 60000 THEN printf('%.0fs', ms / 1000) WHEN ms < 3600000 THEN printf('%.1fm', ms / 60000) WHEN ms < 86400000 THEN printf('%.1fh', ms / 3600000) ELSE printf('%.1fd', ms / 86400000) END AS duration,
CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END END AS ago FROM t""")
def human_times(spark, d):
    ms = F.unix_millis("end_time") - F.unix_millis("start_time")
    return S.chunks(spark, d).select("id", X.human_duration(ms).alias("duration"), X.time_ago(F.col("start_time"), F.lit("2026-02-01").cast("timestamp")).alias("ago"))


@register(f"WITH {P('c')} SELECT id, translate(substr(content, 1, 120), E'\\n', ' ') || CASE WHEN length(content) > 120 THEN '...' ELSE '' END AS preview FROM c")
def previews(spark, d):
    return S.chunks(spark, d).select("id", X.preview(F.col("content"), 120).alias("preview"))


@register()
def heuristic_entries(spark, d):
    """Index entries without a language model: a description of each chunk from its first meaningful lines."""
    t = S.chunks(spark, d).select("id", "session_slug", "start_time", X.heuristic_description(F.col("content")).alias("description"))
    return t.withColumns({"approx_tokens": X.approx_tokens(F.col("description")), "generation_method": F.lit("heuristic")})


@register(f"WITH {P('c')} SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) AS place FROM c")
def seeded_shuffle(spark, d):
    """A reproducible shuffle: rows ranked by the hash of id and seed, by range partitions and offsets."""
    rows = S.chunks(spark, d).select("id", F.md5(F.concat("id", F.lit(":42"))).alias("h"))
    return rank_within(rows, [], ["h", "id"], "place").select("id", (F.col("place") + 1).alias("place"))


_REFS = "the error|that error|this error|the bug|that bug|the issue|that issue|the output|that output|your suggestion|the fix|that function|the function|that file|the file|you mentioned|you showed|you said|as you said|like you said|earlier|previously|before|above".split("|")  # fixed values


@register(f"WITH {P('c')}, p AS (SELECT unnest([{', '.join(q(r) for r in _REFS)}]) AS phrase) SELECT phrase, count(*) AS n FROM c JOIN p ON regexp_matches(content, '(?i)\\b' || replace(phrase, ' ', '\\s+') || '\\b') GROUP BY 1")
def back_references(spark, d):
    """How many chunks refer back, by phrase."""
    hits = F.array_compact(F.array(*[F.when(F.col("content").rlike(r"(?i)\b" + r.replace(" ", r"\s+") + r"\b"), r) for r in _REFS]))
    return S.chunks(spark, d).select(F.explode(hits).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


_ERR = r"(?i)(?:error|failed|exception)[:\s]+(.{10,50})"
_DEF = r"(?i)(?:function|def|fn|func|class|struct|interface|type|const|let|var|val)\s+(\w{3,})"


@register(f"WITH {P('c')}, t AS (SELECT id, session_id, start_time, list_distinct(list_transform(regexp_extract_all(content, {q(_DEF)}, 1), lambda x: lower(x))) AS names FROM c), x AS (SELECT DISTINCT session_id, unnest(names) AS name, id, start_time FROM t), y AS (SELECT *, lag(id) OVER (PARTITION BY session_id, name ORDER BY start_time, id) AS earlier FROM x) SELECT id, earlier, count(*) AS n_names FROM y WHERE earlier IS NOT NULL GROUP BY 1, 2")
def code_entity_references(spark, d):
    """Links from a chunk to the last earlier chunk of its session that names the same code entity."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(_DEF), 1), F.lower))
    x = S.chunks(spark, d).select("session_id", "id", "start_time", F.explode(names).alias("name"))
    w = Window.partitionBy("session_id", "name").orderBy("start_time", "id")
    return x.withColumn("earlier", F.lag("id").over(w)).filter("earlier is not null").groupBy("id", "earlier").agg(F.count("*").alias("n_names"))


# Sentences added to the chunks by the first digit of their id's hash, for features that the stored texts never show.
_PLANTED = {
    "0": "[User]\nbtw, another topic. ", "1": "Continuing from previous session\n", "2": "Ask @kim.lee in #infra. ", "3": "Mail anna.b@example.com, or see https://example.com/a?b=1. ",
    "4": "Tom Baker said so in the standup. ", "5": "[User]\nThanks, it is fixed. Ask @Kim.Lee. ", "6": "Talk with Tom Baker at the all-hands, then #Infra. ",
}


def planted(spark, d):
    """The chunks with those sentences in front."""
    c = S.chunks(spark, d)
    first = F.substring(F.md5("id"), 1, 1)
    text = F.lit("")
    for k, v in _PLANTED.items():
        text = F.when(first == k, F.lit(v)).otherwise(text)
    return c.withColumn("content", F.concat(text, F.coalesce("content", F.lit(""))))


PLANTED_SQL = P("c").replace("c AS (", "c0 AS (", 1) + ", c AS (SELECT * REPLACE (CASE substr(md5(id), 1, 1) " + " ".join("WHEN '{}' THEN {}".format(k, "E" + q(v).replace("\n", "\\n")) for k, v in _PLANTED.items()) + " ELSE '' END || coalesce(content, '') AS content) FROM c0)"


@register(f"WITH {PLANTED_SQL} SELECT id, regexp_matches({_TRIM.format(_USER)}, {q(X.TOPIC_SHIFT)}) AS shift, regexp_matches({_TRIM.format(_USER)}, {q(X.CONTINUATION)}) AS continuation, regexp_matches(content, {q(X.RESUMED)}) AS resumed FROM c")
def topic_markers_planted(spark, d):
    u = X.user_text(F.col("content"))
    return planted(spark, d).select("id", X.has_topic_shift(u).alias("shift"), X.has_continuation(u).alias("continuation"), X.is_resumed(F.col("content")).alias("resumed"))


@register(f"WITH {PLANTED_SQL}, {_ENT} SELECT id, entity_type, mention_form, name, confidence FROM en")
def entities_planted(spark, d):
    return _entity_rows(planted(spark, d)).select("id", "entity_type", "mention_form", "name", "confidence")


@register(f"WITH {PLANTED_SQL}, {_ENT}, k AS (SELECT DISTINCT session_slug, entity_type, name, mention_form FROM en), al AS (SELECT DISTINCT session_slug, id FROM en JOIN k USING (session_slug, entity_type, name) WHERE lower(k.mention_form) = '@kim.lee') SELECT al.id, c.session_slug, c.start_time FROM al JOIN c ON c.id = al.id")
def alias_lookup_planted(spark, d):
    """The chunks of each project that mention the entity which a spelling is an alias of, whatever their own spelling."""
    rows = materialise(_entity_rows(planted(spark, d)), "entities")
    of = rows.filter(F.lower("mention_form") == "@kim.lee").select("session_slug", "entity_type", "name").distinct()
    return rows.join(broadcast_if_small(of), ["session_slug", "entity_type", "name"], "left_semi").select("id", "session_slug", "start_time").distinct()


@register(f"WITH {PLANTED_SQL}, {_ENT} SELECT entity_type, name, session_slug, count(DISTINCT mention_form) AS n_forms, count(DISTINCT id) AS n_chunks FROM en GROUP BY 1, 2, 3")
def entity_resolution_planted(spark, d):
    return _entity_rows(planted(spark, d)).groupBy("entity_type", "name", "session_slug").agg(F.countDistinct("mention_form").alias("n_forms"), F.countDistinct("id").alias("n_chunks"))
