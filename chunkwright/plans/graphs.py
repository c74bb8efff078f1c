"""Graph queries: a conversation is a document, a turn a chunk, its role the heading path below the conversation, its long words entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.functions import models
from chunkwright.operators import graph as G
from chunkwright.plans.corpora import table
from chunkwright.plans.registry import query


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "role", "text").dropDuplicates(["doc_id", "chunk_index"])


_TURNS = "turns AS (SELECT conv_id AS doc_id, turn AS chunk_index, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2)"
_PATHS = "paths AS (SELECT doc_id, chunk_index, CASE chunk_index % 3 WHEN 0 THEN ['c'] WHEN 1 THEN ['c', 'S' || chunk_index // 3] ELSE ['C', 's' || chunk_index // 3, 'x'] END AS path FROM turns)"
_ENTITIES = "entities AS (SELECT DISTINCT doc_id, chunk_index, lower(unnest(list_filter(string_split(text, ' '), lambda w: length(w) > 8))) AS entity FROM turns)"


def _paths(frame):
    c = F.col("chunk_index")
    third = F.expr("chunk_index div 3").cast("string")
    path = F.when(c % 3 == 0, F.array(F.lit("c"))).when(c % 3 == 1, F.array(F.lit("c"), F.concat(F.lit("S"), third))).otherwise(F.array(F.lit("C"), F.concat(F.lit("s"), third), F.lit("x")))
    return frame.select("doc_id", "chunk_index", path.alias("path"))


def _entities(frame):
    return frame.select("doc_id", "chunk_index", F.explode(F.filter(F.split("text", " "), lambda w: F.length(w) > 8)).alias("entity"))


_SEQ = "seq AS (SELECT doc_id, chunk_index AS src, next AS dst, 'Sequential' AS kind, 1e0 AS weight, 'follows' AS label FROM (SELECT *, lead(chunk_index) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS next FROM turns) WHERE next IS NOT NULL)"
_HIER = """hier AS (SELECT a.doc_id, max(b.chunk_index) AS src, a.chunk_index AS dst, 'Hierarchical' AS kind, 0.8e0 AS weight, 'contains' AS label FROM paths a JOIN paths b ON a.doc_id = b.doc_id AND b.chunk_index < a.chunk_index
 AND len(b.path) < len(a.path) AND lower(array_to_string(b.path, '/')) = lower(array_to_string(a.path[1:len(b.path)], '/')) GROUP BY a.doc_id, a.chunk_index)"""
_SHARED = "shared AS (SELECT a.doc_id, a.chunk_index AS src, b.chunk_index AS dst, 'SharedEntity' AS kind, 0.6e0 AS weight, 'shares: ' || a.entity AS label FROM entities a JOIN entities b ON a.doc_id = b.doc_id AND a.entity = b.entity AND a.chunk_index < b.chunk_index AND b.chunk_index - a.chunk_index <= 10)"
_EDGES = f"{_TURNS}, {_PATHS}, {_ENTITIES}, {_SEQ}, {_HIER}, {_SHARED}, edges AS (SELECT * FROM seq UNION ALL SELECT * FROM hier UNION ALL SELECT * FROM shared)"


def all_edges(spark, sf_dir):
    t = turns(spark, sf_dir)
    return G.sequential(t).union(G.hierarchical(_paths(t))).union(G.shared_entities(_entities(t)))


@query("g01_edges", f"WITH {_EDGES} SELECT * FROM edges")
def edges(spark, sf_dir):
    """G01, G02, G03."""
    return all_edges(spark, sf_dir)


@query(
    "g05_capped_edges",
    f"WITH {_EDGES} SELECT doc_id, src, dst, kind, weight, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, src ORDER BY CASE kind WHEN 'Sequential' THEN 0 WHEN 'Hierarchical' THEN 1 ELSE 2 END, dst, label) AS k FROM edges) WHERE k <= 10",
)
def capped_edges(spark, sf_dir):
    return G.capped(all_edges(spark, sf_dir))


@query("g06_nodes", f"WITH {_TURNS} SELECT doc_id, chunk_index, lag(chunk_index) OVER w AS prev_index, lead(chunk_index) OVER w AS next_index FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def nodes(spark, sf_dir):
    return G.nodes(turns(spark, sf_dir))


@query("g07_neighbours", f"WITH {_EDGES} SELECT DISTINCT doc_id, a, b FROM (SELECT doc_id, src AS a, dst AS b FROM edges UNION ALL SELECT doc_id, dst, src FROM edges) WHERE a <> b")
def neighbours(spark, sf_dir):
    return G.neighbours(all_edges(spark, sf_dir))


@query(
    "g08_steps",
    f"""WITH RECURSIVE {_EDGES}, near AS (SELECT doc_id, src AS a, dst AS b FROM edges UNION SELECT doc_id, dst, src FROM edges), reach(doc_id, node, steps) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), 0 FROM near UNION SELECT r.doc_id, n.b, r.steps + 1 FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.a = r.node WHERE r.steps < (SELECT max(n) FROM (SELECT count(DISTINCT a) AS n FROM near GROUP BY doc_id)))
    SELECT doc_id, node, min(steps) AS steps FROM reach GROUP BY doc_id, node""",
)
def steps(spark, sf_dir):
    """Steps of the shortest path from a conversation's first turn."""
    return G.distances(all_edges(spark, sf_dir)).select("doc_id", "node", "steps")


#: From the first and the last turn of each conversation to every turn, and to one that there isn't.
_PAIRS = """ends AS (SELECT doc_id, min(chunk_index) AS first, max(chunk_index) AS last FROM turns GROUP BY doc_id), pairs AS (SELECT DISTINCT t.doc_id, f AS "from", t.chunk_index AS "to" FROM turns t JOIN (SELECT doc_id, unnest([first, last]) AS f FROM ends) USING (doc_id) UNION SELECT doc_id, first, 9999 FROM ends)"""


@query(
    "g08_paths",
    f"""WITH RECURSIVE {_EDGES}, {_PAIRS}, near AS (SELECT doc_id, src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT doc_id, dst, src FROM edges WHERE src <> dst), nodes AS (SELECT max(n) AS most FROM (SELECT count(DISTINCT a) AS n FROM near GROUP BY doc_id)),
    reach(doc_id, start, node, steps) AS (SELECT DISTINCT doc_id, "from", "from", 0 FROM pairs UNION SELECT r.doc_id, r.start, n.b, r.steps + 1 FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.a = r.node WHERE r.steps < (SELECT most FROM nodes)),
    dist AS (SELECT doc_id, start, node, min(steps) AS steps FROM reach GROUP BY 1, 2, 3), pred AS (SELECT v.doc_id, v.start, v.node, min(u.node) AS before FROM dist v JOIN near n ON n.doc_id = v.doc_id AND n.b = v.node JOIN dist u ON u.doc_id = v.doc_id AND u.start = v.start AND u.node = n.a AND u.steps = v.steps - 1 GROUP BY 1, 2, 3),
    back(doc_id, start, target, node, path) AS (SELECT p.doc_id, p."from", p."to", p."to", CAST(p."to" AS VARCHAR) FROM pairs p JOIN dist d ON d.doc_id = p.doc_id AND d.start = p."from" AND d.node = p."to" UNION ALL SELECT b.doc_id, b.start, b.target, p.before, p.before || ',' || b.path FROM back b JOIN pred p ON p.doc_id = b.doc_id AND p.start = b.start AND p.node = b.node)
    SELECT p.doc_id, p."from", p."to", b.path FROM pairs p LEFT JOIN back b ON b.doc_id = p.doc_id AND b.start = p."from" AND b.target = p."to" AND b.node = p."from" """,
)
def paths(spark, sf_dir):
    """The nodes of shortest paths between stated pairs."""
    t = turns(spark, sf_dir)
    ends = t.groupBy("doc_id").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))
    pairs = t.join(ends, "doc_id").select("doc_id", F.explode(F.array("first", "last")).alias("from"), F.col("chunk_index").alias("to"))
    found = G.shortest_paths(all_edges(spark, sf_dir), pairs.union(ends.select("doc_id", "first", F.lit(9999))))
    return found.select("doc_id", "from", "to", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


_WORDS = lambda t: f"list_distinct(regexp_extract_all(lower({t}), '[a-z]+'))"
_SAID = lambda t: f"list_filter(string_split_regex({t}, '[.!?\\n]'), lambda s: list_contains(regexp_extract_all(lower(s), '[a-z]+'), w))[1]"
_TRIM = lambda t: f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


@query(
    "u08_multi_hop_questions",
    f"""WITH {_EDGES}, pairs AS (SELECT DISTINCT doc_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst), b AS (SELECT p.*, x.text AS one, y.text AS other, {_WORDS('x.text')} AS own, {_WORDS('y.text')} AS theirs FROM pairs p JOIN turns x ON x.doc_id = p.doc_id AND x.chunk_index = p.src JOIN turns y ON y.doc_id = p.doc_id AND y.chunk_index = p.dst),
    s AS (SELECT *, list_intersect(own, theirs) AS shared FROM b), w AS (SELECT *, list_sort(list_transform(list_filter(shared, lambda x: length(x) >= 6), lambda x: {{'n': -length(x), 'w': x}}))[1].w AS w FROM s),
    a AS (SELECT doc_id, src, dst, 'What do both passages say about ' || w || '?' AS question, {_TRIM(_SAID('one'))} || ' / ' || {_TRIM(_SAID('other'))} AS answer, len(shared) / least(len(own), len(theirs)) AS score FROM w WHERE w IS NOT NULL),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id, src, dst) AS k FROM a WHERE score >= 0.1) WHERE k = 1)
    SELECT doc_id, src, dst, question, answer, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, src, dst, question) AS rank FROM o) WHERE rank <= 3""",
)
def multi_hop_questions(spark, sf_dir):
    """Questions on pairs of turns that an edge of the graph relates."""
    found = G.multi_hop(turns(spark, sf_dir), all_edges(spark, sf_dir), models.bridge)
    return found.select("doc_id", "src", "dst", "question", "answer", F.round("score", 9).alias("score"), "rank")


@query("g09_hierarchy", f"WITH {_EDGES} SELECT doc_id, src AS parent, count(*) AS n_children, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS children FROM hier GROUP BY doc_id, src")
def hierarchy(spark, sf_dir):
    h = G.hierarchical(_paths(turns(spark, sf_dir)))
    return h.groupBy("doc_id", F.col("src").alias("parent")).agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("dst")).cast("array<string>"), ",").alias("children"))
