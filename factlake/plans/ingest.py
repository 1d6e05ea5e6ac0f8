"""Queries of what is written: vectors in the log and in spaces, facts extracted from conversations, and planned requests; and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlake.operators import extraction as X
from factlake.operators import lifecycle as L
from factlake.operators import planning as P
from factlake.plans import catalogue as C
from factlake.sources import facts as S
from factlake.sources import folders, spaces

#: Widths of the spaces that space_vectors writes.
WIDTHS = {"whole": 64, "head": 16}
#: Words from which a sentence is a fact for the extractors, and facts of a window from which the extractor fails.
WORDS, OLD_WORDS, MOST_FACTS = 12, 10, 20


def log_vectors(spark, d):
    """Vectors that the events leave as a log: clicks embed their user's row anew, errors close it, purchases delete it, all others write it."""
    e = spark.read.parquet(f"{d}/events.parquet")
    log = S.change_log(spark, d).join(e.select(F.col("event_id").alias("seq"), "event_type", "value"), "seq")
    op = F.when(F.col("event_type") == "click", "embed").otherwise(F.col("op"))
    return L.fold_vectors(log.withColumn("op", op).withColumn("vector", F.array("value", F.col("seq").cast("double")))).select("id", *[F.element_at("vector", i).alias(n) for i, n in ((1, "x"), (2, "y"))], "embedded_at")


def space_vectors(spark, d):
    """Vectors of two spaces, each read by itself after every third of the first was written again backwards."""
    at, v = folders.scratch(spark, "spaces"), S.vectors(spark, d).withColumn("embedded_at", F.lit(S.NOW).cast("timestamp"))
    spaces.write(v, at, "whole", WIDTHS)
    spaces.write(v.withColumn("vector", F.slice("vector", 1, 16)), at, "head", WIDTHS)
    spaces.write(v.filter("cast(fact_id as long) % 3 = 0").withColumn("vector", F.reverse("vector")), at, "whole", WIDTHS)
    spaces.write(v, at, "head", WIDTHS)  # of another width, so nothing
    one = lambda mode: spaces.read(spark, at, mode, WIDTHS).select(F.lit(mode).alias("mode"), "fact_id", F.size("vector").alias("width"), F.round(F.element_at("vector", 1), 6).alias("x"))
    return one("whole").unionByName(one("head"))


def _sentences(words):
    def found(text):
        facts = [p.strip(" \n") for p in text.split(".") if len(p.split(" ")) >= words]
        if len(facts) > MOST_FACTS:
            raise ValueError("too many facts")
        return facts

    return found


def _windows(spark, d):
    return X.windows(spark.read.parquet(f"{d}/conversations.parquet"))


KEYS = ["conv_id", "window"]


def extracted_facts(spark, d):
    """Sentences of some words as facts of each window of the conversations; windows with too many fail."""
    out = X.extract(_windows(spark, d), _sentences(WORDS), KEYS)
    return out.select(*KEYS, "place", F.sha2("fact", 256).alias("text_key"), "error")


def _again(spark, d):
    at, scope = F.lit(S.NOW).cast("timestamp"), F.lit("talk")
    w = _windows(spark, d)
    old = X.changes(X.extract(w, _sentences(OLD_WORDS), KEYS), KEYS, scope, at)
    affected = old.filter(F.get_json_object("payload", "$.origin").rlike("[05]/[0-9]+$"))
    return X.again(old, affected, w, _sentences(WORDS), KEYS, scope, at)


def reextracted_changes(spark, d):
    """What extracting the windows of some facts anew, with another extractor, writes and deletes."""
    return _again(spark, d)[0].select("op", "id", F.get_json_object("payload", "$.origin").alias("origin"))


def _planned(spark, d):
    f = S.facts(spark, d)
    requests = f.select(
        F.col("ord").alias("request"), "scope", F.col("data").alias("text"), "kind", F.when(F.col("ord") % 7 > 0, F.col("ord") % 2 == 0).alias("shareable"),
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit('{"kind":"old","n":'), "id", F.lit("}"))).alias("metadata"), (F.col("ord") % 4 > 0).alias("verbatim"), F.when(F.col("ord") % 5 == 0, F.concat(F.lit("about "), "name")).alias("embed_text"),
    )

    def lines(rows):
        each = rows.select("request", F.posexplode(F.split("text", "\n")).alias("place", "text")).filter("trim(text) <> ''")
        event = F.get(F.array(*map(F.lit, ["add", "UPDATE", "DELETE", "none"])), F.col("place") % 4)
        return each.withColumn("event", event).withColumn("id", X.ident(F.col("request"), F.col("place"), F.lit("line")))

    size = lambda t: F.when(F.length(t) % 6 != 0, F.array(F.length(t).cast("double"), F.lit(1.0)))
    return P.plan(requests, lines, size, 2, F.lit(S.NOW).cast("timestamp"))


def planned_changes(spark, d):
    """What requests write: whole texts, or lines that are added, change a fact or delete one; with the vector of another text where one is given."""
    out, value = _planned(spark, d)[0], lambda k: F.get_json_object("payload", f"$.{k}")
    return out.select("op", "id", "n", *[value(k).alias(k) for k in ("kind", "shareable", "user_id")], value("n").alias("number"), F.sha2(value("data"), 256).alias("text_key"), F.element_at("vector", 1).alias("x"))


def planned_outcomes(spark, d):
    """What each request is told: ids of what it added, how many facts it stored, and how many couldn't be embedded."""
    return _planned(spark, d)[1].select("request", F.size("ids").cast("long").alias("added"), F.sha2(F.array_join("ids", ","), 256).alias("ids_key"), "stored", "failed")


_ALL = (log_vectors, space_vectors, extracted_facts, reextracted_changes, planned_changes, planned_outcomes)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _uuid(*parts: str) -> str:
    m = "md5(" + " || chr(10) || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"regexp_replace({m}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def oracle_sql() -> dict[str, str]:
    found = lambda words: f"list_transform(list_filter(string_split(t, '.'), lambda p: len(string_split(p, ' ')) >= {words}), lambda p: trim(p, E' \\n'))"
    windows = f"""WITH w AS (SELECT conv_id, turn // 10 AS "window", string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1, 2),
      f AS (SELECT conv_id, "window", {found(WORDS)} AS facts, {found(OLD_WORDS)} AS old FROM w)"""
    each = lambda c, where: f'SELECT conv_id, "window", CAST(unnest(range(len({c}))) AS INT) AS place, unnest({c}) AS fact FROM f WHERE len({c}) <= {MOST_FACTS}{where}'
    id_ = _uuid("conv_id", '"window"', "place", "fact")
    origin = "conv_id || '/' || \"window\""
    planned = f"""WITH {C.FACTS}, r AS (SELECT ord AS request, scope, data AS text, kind, CASE WHEN ord % 7 > 0 THEN ord % 2 = 0 END AS shareable, ord % 3 = 0 AS meta, ord % 4 > 0 AS verbatim, CASE WHEN ord % 5 = 0 THEN 'about ' || name END AS other FROM facts),
      l AS (SELECT *, string_split(text, chr(10)) AS parts FROM r WHERE NOT verbatim), e AS (SELECT * EXCLUDE (parts, text), CAST(unnest(range(len(parts))) AS INT) AS place, unnest(parts) AS text FROM l),
      ev AS (SELECT request, scope, kind, shareable, meta, other, CAST(0 AS INT) AS place, text, 'ADD' AS event, {_uuid("request", "'verbatim'", "text")} AS id FROM r WHERE verbatim AND trim(coalesce(text, '')) <> ''
        UNION ALL SELECT request, scope, kind, shareable, meta, other, place, text, ['ADD', 'UPDATE', 'DELETE', 'NONE'][place % 4 + 1], {_uuid("request", "place", "'line'")} FROM e WHERE trim(text) <> ''),
      sized AS (SELECT *, length(left(text, 32000)) AS own, CASE WHEN event = 'ADD' AND coalesce(other, '') <> '' AND other <> text THEN length(other) END AS more FROM ev),
      put AS (SELECT *, own % 6 <> 0 AS good, CAST(CASE WHEN more % 6 <> 0 THEN more ELSE own END AS DOUBLE) AS x FROM sized WHERE event IN ('ADD', 'UPDATE'))"""
    return {
        "log_vectors": """WITH log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, ts AS moment, value, CASE event_type WHEN 'error' THEN 'invalidate' WHEN 'purchase' THEN 'delete' WHEN 'click' THEN 'embed' ELSE 'upsert' END AS op FROM events),
          since AS (SELECT * FROM log WHERE op IN ('upsert', 'embed') AND seq > coalesce((SELECT max(seq) FROM log g WHERE g.id = log.id AND g.op = 'delete'), -1)), begun AS (SELECT id, min(seq) AS first FROM since WHERE op = 'upsert' GROUP BY id)
          SELECT id, arg_max(value, seq) AS x, CAST(max(seq) AS DOUBLE) AS y, arg_max(moment, seq) AS embedded_at FROM since JOIN begun USING (id) WHERE seq >= first GROUP BY id""",
        "space_vectors": """SELECT 'whole' AS mode, CAST(vec_id AS VARCHAR) AS fact_id, CAST(64 AS INT) AS width, round(CAST(CASE WHEN vec_id % 3 = 0 THEN embedding[64] ELSE embedding[1] END AS DOUBLE), 6) AS x FROM embeddings
          UNION ALL SELECT 'head', CAST(vec_id AS VARCHAR), CAST(16 AS INT), round(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings""",
        "extracted_facts": f"""{windows} SELECT conv_id, "window", place, sha256(fact) AS text_key, CAST(NULL AS VARCHAR) AS error FROM ({each("facts", "")})
          UNION ALL SELECT conv_id, "window", NULL, NULL, 'ValueError: too many facts' FROM f WHERE len(facts) > {MOST_FACTS}""",
        "reextracted_changes": f"""{windows}, old AS ({each("old", "")}), olds AS (SELECT {id_} AS id, {origin} AS origin FROM old), mine AS (SELECT DISTINCT origin FROM olds WHERE regexp_matches(origin, '[05]/[0-9]+$')),
          redone AS (SELECT origin FROM mine JOIN f ON origin = {origin} WHERE len(facts) <= {MOST_FACTS}), new AS ({each("facts", "")}), news AS (SELECT {id_} AS id, {origin} AS origin FROM new SEMI JOIN redone ON redone.origin = {origin})
          SELECT 'upsert' AS op, id, origin FROM news UNION ALL SELECT 'delete', id, NULL FROM olds SEMI JOIN redone USING (origin) WHERE id NOT IN (SELECT id FROM news)""",
        "planned_changes": f"""{planned} SELECT 'upsert' AS op, id, CAST(place AS BIGINT) AS n, kind, CAST(shareable AS VARCHAR) AS shareable, scope AS user_id, CASE WHEN meta THEN CAST(request AS VARCHAR) END AS number, sha256(text) AS text_key, x FROM put WHERE good
          UNION ALL SELECT 'delete', id, CAST(place AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL FROM ev WHERE event = 'DELETE'""",
        "planned_outcomes": f"""{planned}, t AS (SELECT request, count(*) FILTER (good AND event = 'ADD') AS added, string_agg(id, ',' ORDER BY place) FILTER (good AND event = 'ADD') AS ids, count(*) FILTER (good) AS stored, count(*) FILTER (NOT good) AS failed FROM put GROUP BY request)
          SELECT request, coalesce(added, 0) AS added, sha256(coalesce(ids, '')) AS ids_key, coalesce(stored, 0) AS stored, coalesce(failed, 0) AS failed FROM r LEFT JOIN t USING (request)""",
    }
