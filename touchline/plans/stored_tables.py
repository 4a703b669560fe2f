"""Stored tables (2.A): loads that run again, and the answer cache."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer_cache as AC
from ..operators import vectors as V
from ..session import scratch_path
from ..sources import stored
from ..sources.projections import MatchData
from .catalog import register
from .services import ASK_EVERY, _asked, _stored

EPOCH = 1704067200


def _loads(md: MatchData) -> dict[str, tuple[DataFrame, list[str]]]:
    return {"competitions": (md.competitions, ["competition_id"]), "teams": (md.teams, ["team_id"]),
            "matches": (md.matches, ["match_id"]), "players": (md.players, ["player_id"])}


@register("load_again", """
SELECT table_name, row_count, row_count AS row_count_again, true AS unchanged, true AS as_source FROM (
  SELECT 'competitions' AS table_name, count(*) AS row_count FROM v_competitions
  UNION ALL SELECT 'teams', count(*) FROM v_teams UNION ALL SELECT 'matches', count(*) FROM v_matches
  UNION ALL SELECT 'players', count(*) FROM v_players) t
""", ("v_competitions", "v_teams", "v_matches", "v_players"))
def load_again(md: MatchData) -> DataFrame:
    """The tables are loaded into stored tables, stopped before the load is
    noted, loaded again, and loaded once more as a new batch; counts and checksums
    after the first and the last load, and against the source."""
    class Stopped(Exception):
        pass

    def stop():
        raise Stopped

    root, out = scratch_path(md.spark, f"stored/{uuid.uuid4().hex[:12]}"), None
    for name, (rows, keys) in _loads(md).items():
        path = f"{root}/{name}"
        try:
            stored.merge(rows, path, keys, "first", before_note=stop)
        except Stopped:
            pass
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        first = stored.state(stored.read(md.spark, path, schema)).first()
        for batch in ("first", "first", "second"):
            stored.merge(rows, path, keys, batch)
        last = stored.state(stored.read(md.spark, path, schema)).first()
        source = stored.state(rows).first()
        one = md.spark.createDataFrame([(name, first[0], last[0], first == last, last == source)],
                                       "table_name string, row_count long, row_count_again long, unchanged boolean, as_source boolean")
        out = one if out is None else out.unionByName(one)
    return out


def _answers(md: MatchData) -> DataFrame:
    """An answer to every 50th vector: its three nearest entries."""
    top = V.nearest(_stored(md), _asked(md), 3)
    rows = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id"))).alias("top"))
    ids = F.transform("top", lambda r: r["entry_id"].cast("string"))
    cells = F.transform("top", lambda r: F.create_map(F.lit("rank"), r["rank"].cast("string"), F.lit("entry_id"), r["entry_id"].cast("string")))
    none = F.array().cast("array<string>")
    return rows.join(_asked(md), "query_id").select(
        "query_id", F.concat(F.lit("what is near "), F.col("query_id").cast("string"), F.lit("?")).alias("question"), "embedding",
        F.concat(F.lit("nearest "), F.array_join(ids, ", ")).alias("answer"), F.lit("SELECT 1").alias("generated_sql"),
        F.lit("SELECT 1 LIMIT 100").alias("executed_sql"), F.array(F.lit("rank"), F.lit("entry_id")).alias("result_columns"), cells.alias("result_rows"),
        F.size("top").cast("long").alias("row_count"), F.lit(False).alias("truncated"), F.lit(True).alias("grounded"),
        none.alias("ungrounded_numbers"), F.array().cast("array<map<string,string>>").alias("glossary"), F.lit("m").alias("model"),
        F.col("language").cast("string").alias("language"))


@register("cache_round_trip", f"""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % {ASK_EVERY} = 0),
near AS (SELECT q.vec_id AS query_id, v.vec_id AS entry_id, row_number() OVER (PARTITION BY q.vec_id
           ORDER BY round(1.0 - list_cosine_similarity(v.embedding::DOUBLE[], q.e), 9), v.vec_id) AS rank FROM q, embeddings v),
ans AS (SELECT query_id, 'nearest ' || string_agg(cast(entry_id AS varchar), ', ' ORDER BY rank) AS answer, count(*) AS row_count,
               max(CASE WHEN rank = 1 THEN cast(entry_id AS varchar) END) AS first_id FROM near WHERE rank <= 3 GROUP BY query_id),
clock AS (SELECT max(vec_id) AS top FROM embeddings),
ent AS (SELECT q.*, q.vec_id * 3600 AS made FROM q UNION ALL SELECT q.*, q.vec_id * 3600 + 86400 FROM q WHERE q.vec_id % {2 * ASK_EVERY} = 0),
fresh AS (SELECT ent.* FROM ent, clock WHERE made >= top * 3600 + 86400 - top * 1800),
hit AS (SELECT q.vec_id AS query_id, f.vec_id AS found, 1.0 - list_cosine_similarity(f.e, q.e) AS distance FROM q JOIN fresh f ON f.label = q.label
        WHERE 1.0 - list_cosine_similarity(f.e, q.e) <= 1.0 - 0.97
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1.0 - list_cosine_similarity(f.e, q.e), 9), f.vec_id) = 1)
SELECT h.query_id, 'what is near ' || cast(h.found AS varchar) || '?' AS question, a.answer, a.row_count, a.first_id, round(h.distance, 6) AS distance,
       (SELECT count(*) FROM ent) AS stored_entries
FROM hit h JOIN ans a ON a.query_id = h.found
""")
def cache_round_trip(md: MatchData) -> DataFrame:
    """Answers appended in two batches (the first run twice), then looked up
    among the entries of the fresher half of the table's time, with the whole stored answer."""
    path = scratch_path(md.spark, f"stored/cache-{uuid.uuid4().hex[:12]}")
    answers = _answers(md)
    hours = F.regexp_extract("question", r"(\d+)", 1).cast("long") * 3600
    for _ in range(2):
        AC.append(answers, path, "one", F.timestamp_seconds(F.lit(EPOCH) + hours))
    AC.append(answers.where(F.col("query_id") % (2 * ASK_EVERY) == 0), path, "two", F.timestamp_seconds(F.lit(EPOCH + 86400) + hours))
    top = md.read("embeddings", "vec_id").agg(F.max("vec_id")).first()[0] or 0
    asked = _asked(md).withColumn("language", F.col("language").cast("string"))
    hits = AC.lookup(asked, path, F.timestamp_seconds(F.lit(EPOCH + top * 3600 + 86400)), max_age_seconds=top * 1800)
    n = AC.entries(md.spark, path).count()
    return hits.select("query_id", "question", "answer", "row_count", F.try_element_at("result_rows", F.lit(1))["entry_id"].alias("first_id"),
                       F.round("distance", 6).alias("distance"), F.lit(n).cast("long").alias("stored_entries"))
