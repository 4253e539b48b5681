"""Queries: the stored library, its files, folders, names and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.catalog.registry import DIGITS, query
from colloquy.operators import library, models
from colloquy.schema import languages
from colloquy.session import new_path
from colloquy.sources import documents as docs
from colloquy.sources import files as file_sources
from colloquy.sources import versions

# -- files -----------------------------------------------------------------------


@query(
    "scan_library",
    """SELECT meeting_id, title, CAST(count(*) AS BIGINT) AS n_turns FROM (
         SELECT m.meeting_id, m.title, t.turn_id FROM meetings m JOIN turns t ON t.meeting_id = m.meeting_id
         WHERE m.conv_id % 17 <> 0 AND m.conv_id % 19 <> 0) GROUP BY ALL""",
)
def _(t):
    # A tree of one file per meeting; some are cut short, some of a newer version.
    turn = F.struct(F.col("speaker_id").alias("speakerId"), "start", "end", "text")
    spoken = t.turns.groupBy("meeting_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn_idx", turn.alias("t")))), lambda x: x["t"]
        ).alias("utterances")
    )
    text = F.to_json(
        F.struct(
            F.col("meeting_id").alias("id"),
            F.when(F.col("conv_id") % 19 == 0, 2).otherwise(1).alias("schemaVersion"),
            "title",
            "duration",
            "language",
            "utterances",
        )
    )
    text = F.when(F.col("conv_id") % 17 == 0, F.substring(text, 1, 60)).otherwise(text)
    path = new_path(t.spark, "library")
    # Tasks move their files into place; else the driver does, one after the other.
    t.meetings.join(spoken, "meeting_id").select(
        (F.col("conv_id") % 5).alias("folder"), F.col("meeting_id").alias("file"), text.alias("value")
    ).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder", "file").text(path)
    meetings, _ = docs.scan_library(t.spark, path, "*.txt")
    return meetings.select(
        "meeting_id", "title", F.size("utterances").cast("long").alias("n_turns")
    )


@query(
    "dedupe_newest_file",
    """SELECT meeting_id, path FROM copies
       QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY modified DESC, path) = 1""",
    """
copies AS (
  SELECT 'm' || doc_id % 70 AS meeting_id, source || '/' || doc_id || '.json' AS path,
         make_timestamp((1704067200 + n_chars % 50) * 1000000) AS modified FROM documents
)""",
)
def _(t):
    copies = t.read("documents").select(
        F.concat(F.lit("m"), (F.col("doc_id") % 70).cast("string")).alias("meeting_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n_chars") % 50).alias("modified"),
    )
    return library.newest_file(copies).select("meeting_id", "path")


NAMED = """
items AS (
  SELECT doc_id AS item_id, source AS folder, imported_at,
         CASE doc_id % 4 WHEN 0 THEN 'Kickoff' WHEN 1 THEN 'kickoff'
           WHEN 2 THEN 'Kickoff ' || (2 + doc_id // 4 % 4) ELSE 'Notes ' || lang END AS name
  FROM library
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY imported_at, item_id) - 1 AS rk
  FROM items
),
held AS (
  SELECT folder, TRY_CAST(substr(lower(name), 9) AS BIGINT) AS n FROM ranked
  WHERE rk = 0 AND lower(name) LIKE 'kickoff _'
),
free_numbers AS (
  SELECT folder, n, row_number() OVER (PARTITION BY folder ORDER BY n) AS j FROM (
    SELECT DISTINCT folder, unnest(range(2, 20000)) AS n FROM (SELECT DISTINCT folder FROM items)) f
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.folder = f.folder AND h.n = f.n)
)"""


@query(
    "unique_output_names",
    """SELECT r.item_id, r.folder, CASE WHEN rk = 0 THEN name
         WHEN lower(name) = 'kickoff' THEN name || ' ' || f.n ELSE name || ' ' || (rk + 1) END
         AS unique_name
       FROM ranked r LEFT JOIN free_numbers f ON r.folder = f.folder AND r.rk = f.j""",
    NAMED,
)
def _(t):
    doc = F.col("doc_id")
    number = (F.lit(2) + F.floor(doc / 4).cast("long") % 4).cast("string")
    items = t.library.select(
        doc.alias("item_id"),
        F.col("source").alias("folder"),
        "imported_at",
        F.when(doc % 4 == 0, "Kickoff")
        .when(doc % 4 == 1, "kickoff")
        .when(doc % 4 == 2, F.concat(F.lit("Kickoff "), number))
        .otherwise(F.concat(F.lit("Notes "), "lang"))
        .alias("name"),
    )
    day = F.floor(F.unix_timestamp("imported_at") / 86_400).cast("long")
    named = library.unique_names(items, [F.col("imported_at"), F.col("item_id")], day)
    return named.select("item_id", "folder", "unique_name")


LISTING = """
listing AS (SELECT 'lib/' || source || '/' || lang || '/' || doc_id AS path, bytes AS length FROM library)"""


@query(
    "folder_bytes",
    """SELECT folder, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS files FROM (
         SELECT unnest(['lib', 'lib/' || source, 'lib/' || source || '/' || lang]) AS folder,
                bytes AS length FROM library) GROUP BY 1""",
    LISTING,
)
def _(t):
    listing = t.library.select(
        F.concat_ws("/", F.lit("lib"), "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        F.col("bytes").alias("length"),
    )
    return library.folder_bytes(listing)


AUDIT = """
stored AS (SELECT 'f' || doc_id AS path, sha256(text) AS digest FROM library WHERE doc_id % 10 <> 4),
manifest AS (
  SELECT source || '-' || lang AS component, 'f' || doc_id AS path,
         CASE WHEN doc_id % 50 = 3 THEN 'other' ELSE sha256(text) END AS expected
  FROM library WHERE doc_id % 9 <> 5
),
audit AS (
  SELECT coalesce(f.path, m.path) AS path, component,
         CASE WHEN expected IS NULL THEN 'unlisted' WHEN digest IS NULL THEN 'missing'
              WHEN digest = expected THEN 'ok' ELSE 'changed' END AS status
  FROM stored f FULL JOIN manifest m ON f.path = m.path
)"""


def audit(t):
    digest = F.sha2(F.col("text").cast("binary"), 256)
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    stored = t.library.where("doc_id % 10 <> 4").select(path.alias("path"), digest.alias("digest"))
    manifest = t.library.where("doc_id % 9 <> 5").select(
        F.concat_ws("-", "source", "lang").alias("component"),
        path.alias("path"),
        F.when(F.col("doc_id") % 50 == 3, "other").otherwise(digest).alias("expected"),
    )
    return library.checksum_audit(stored, manifest)


@query("checksum_audit", "SELECT path, component, status FROM audit", AUDIT)
def _(t):
    return audit(t)


@query(
    "complete_components",
    """SELECT component, bool_and(status = 'ok') AS complete FROM audit
       WHERE component IS NOT NULL GROUP BY 1""",
    AUDIT,
)
def _(t):
    return library.complete_components(audit(t))


@query(
    "write_through_upsert",
    """SELECT meeting_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE lang END AS lang FROM library
       WHERE doc_id % 5 <> 1 AND (doc_id % 3 <> 2 OR doc_id % 7 = 0)""",
)
def _(t):
    # Stored without every third; every seventh is changed or added, every fifth deleted.
    rows = t.library.select("meeting_id", "doc_id", "lang")
    path = new_path(t.spark, "snapshot")
    file_sources.write_snapshot(rows.where("doc_id % 3 <> 2"), path)
    changes = rows.where("doc_id % 7 = 0").withColumn("lang", F.lit("changed"))
    deletes = rows.where("doc_id % 5 = 1").select("meeting_id")
    file_sources.upsert_snapshot(t.spark, path, changes, deletes)
    return file_sources.read_snapshot(t.spark, path).select("meeting_id", "lang")


@query(
    "store_versions",
    """SELECT 'second' AS version, meeting_id, lang FROM second UNION ALL
       SELECT 'newest', meeting_id, CASE WHEN doc_id % 4 = 0 THEN 'again' ELSE lang END FROM (
         SELECT meeting_id, doc_id, lang FROM second UNION
         SELECT meeting_id, doc_id, 'new' FROM library WHERE doc_id % 4 = 0
           AND meeting_id NOT IN (SELECT meeting_id FROM second)) WHERE doc_id % 11 <> 3""",
    """
second AS (
  SELECT meeting_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE lang END AS lang FROM library
  WHERE doc_id % 5 <> 1 AND (doc_id % 3 <> 2 OR doc_id % 7 = 0)
)""",
)
def _(t):
    # Two changes, then buckets with more than one to merge are compacted; the second version is still there.
    rows = t.library.select("meeting_id", "doc_id", "lang")
    root = new_path(t.spark, "store")
    versions.create_store(rows.where("doc_id % 3 <> 2"), root, buckets=8)
    ids = rows.select("doc_id", "meeting_id")
    changes = rows.where("doc_id % 7 = 0").withColumn("lang", F.lit("changed"))
    second = versions.commit(root, changes, ids.where("doc_id % 5 = 1"))
    again = rows.where("doc_id % 4 = 0").withColumn("lang", F.lit("again"))
    versions.commit(root, again, ids.where("doc_id % 11 = 3"))
    versions.compact(t.spark, root, most_changes=1)

    def read(name, number=None):
        found = versions.read_store(t.spark, root, number)
        return found.select(F.lit(name).alias("version"), "meeting_id", "lang")

    return read("second", second.number).unionByName(read("newest"))


# -- trees of real files ---------------------------------------------------------------

TREE = """
tree AS (
  SELECT source, lang, source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id,
         strlen(text) AS length, sha256(text) AS digest FROM library
)"""

#: Bytes read at a time in these queries: many files are longer.
SMALL_PIECE = 4096


def tree(t) -> str:
    """A folder of one file per document, by source and language."""
    path = new_path(t.spark, "tree")
    name = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    file_sources.put_files(t.library.select(name.alias("name"), "text"), path)
    return path


@query("file_digests", "SELECT path, length, digest FROM tree", TREE)
def _(t):
    root = tree(t)
    found = file_sources.digest_files(t.spark, root, SMALL_PIECE)
    return found.select("path", "length", "digest")


@query(
    "tree_bytes",
    """SELECT folder, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS files FROM (
         SELECT unnest([source, source || '/' || lang]) AS folder, length FROM tree) GROUP BY 1""",
    TREE,
)
def _(t):
    root = tree(t)
    listed = file_sources.list_files(t.spark, root)
    return library.folder_bytes(listed.select("path", "length"))


@query(
    "tree_audit",
    """SELECT coalesce(f.path, w.path) AS path, component,
              CASE WHEN w.path IS NULL THEN 'unlisted' WHEN f.path IS NULL THEN 'missing'
                   WHEN doc_id % 50 = 3 THEN 'changed' ELSE 'ok' END AS status
       FROM (SELECT path FROM tree WHERE doc_id % 10 <> 4) f
       FULL JOIN (SELECT path, doc_id, source || '-' || lang AS component FROM tree WHERE doc_id % 9 <> 5) w
         ON f.path = w.path""",
    TREE,
)
def _(t):
    # Files that were removed, changed in place, or are not in the manifest.
    root = tree(t)
    name = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    manifest = t.library.where("doc_id % 9 <> 5").select(
        F.concat_ws("-", "source", "lang").alias("component"),
        name.alias("path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("expected"),
    )
    named = t.library.select("doc_id", name.alias("name"), F.concat("text", F.lit("!")).alias("text"))
    file_sources.put_files(named.where("doc_id % 50 = 3"), root)
    file_sources.remove_files(named.where("doc_id % 10 = 4"), root)
    found = file_sources.digest_files(t.spark, root, SMALL_PIECE)
    stored = found.select("path", "digest")
    return library.checksum_audit(stored, manifest)


# -- folders and order ---------------------------------------------------------------


@query(
    "folder_rollup",
    """SELECT folder, count(*) AS meetings FROM (
         SELECT unnest(['', source, source || '/' || lang]) AS folder FROM library) GROUP BY 1""",
)
def _(t):
    return library.folder_rollup(t.library).select(
        F.array_join("folder", "/").alias("folder"), "meetings"
    )


@query(
    "folder_order",
    """SELECT DISTINCT folder, sort_key FROM (
         SELECT source AS folder, 'src' || lpad(len(n)::VARCHAR, 10, '0') || n AS sort_key FROM numbered
         UNION ALL
         SELECT folder, 'src' || lpad(len(n)::VARCHAR, 10, '0') || n || '/' || lang FROM numbered)""",
    "numbered AS (SELECT *, CAST(CAST(substr(source, 4) AS BIGINT) AS VARCHAR) AS n FROM library)",
)
def _(t):
    # One row per folder; the order itself is a range-partitioned sort.
    folders = library.folder_rollup(t.library).where(F.size("folder") > 0).select("folder")
    key = library.natural_key(F.col("folder"))
    return library.folder_order(folders).select(
        F.array_join("folder", "/").alias("folder"), F.array_join(key, "/").alias("sort_key")
    )


@query("library_order", "SELECT meeting_id, imported_at FROM library")
def _(t):
    return library.library_order(t.library).select("meeting_id", "imported_at")


@query(
    "duplicate_recordings",
    """SELECT meeting_id, audio_path, count(*) OVER (PARTITION BY audio_path) AS copies FROM meetings
       QUALIFY count(*) OVER (PARTITION BY audio_path) > 1""",
)
def _(t):
    return library.duplicate_recordings(t.meetings).select("meeting_id", "audio_path", "copies")


@query(
    "top1_by",
    """SELECT lang, source, meeting_id FROM library
       QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY bytes DESC, doc_id) = 1""",
)
def _(t):
    best = F.struct(F.col("bytes"), (-F.col("doc_id")).alias("first"))
    return t.library.groupBy("lang", "source").agg(
        F.max_by("meeting_id", best).alias("meeting_id")
    )


# -- models ---------------------------------------------------------------------------


@query(
    "model_routing",
    """SELECT m.meeting_id, coalesce(m.model, l.default_model) AS model, c.choices, s.supported,
              round(duration / 3600 * s.minutes_per_hour, 6) AS minutes
       FROM meetings m JOIN languages l ON m.language = l.language
       JOIN (SELECT language, string_agg(model, ',' ORDER BY choice_pos) AS choices FROM choices GROUP BY 1) c
         ON c.language = m.language
       LEFT JOIN support s ON s.language = m.language AND s.model = coalesce(m.model, l.default_model)""",
)
def _(t):
    return models.model_routing(t.meetings).select(
        "meeting_id", "model", "choices", "supported", F.round("minutes", DIGITS).alias("minutes")
    )


MEMORY = """
memory AS (
  SELECT meeting_id, language || '=' || CASE conv_id % 3 WHEN 0 THEN 'whisper-large-v3'
           WHEN 1 THEN 'pianissimo-sv' ELSE 'apple-speech' END || ';swedish=pianissimo-sv;broken;danish=nothing'
         AS stored, language, CASE conv_id % 3 WHEN 0 THEN 'whisper-large-v3'
           WHEN 1 THEN 'pianissimo-sv' ELSE 'apple-speech' END AS model FROM meetings
),
remembered AS (
  SELECT meeting_id, language, model FROM memory m WHERE language <> 'swedish'
    AND EXISTS (SELECT 1 FROM choices c WHERE c.language = m.language AND c.model = m.model)
  UNION ALL SELECT meeting_id, 'swedish', 'pianissimo-sv' FROM memory
)"""


def memories(t):
    at = F.col("conv_id") % 3
    model = (
        F.when(at == 0, "whisper-large-v3").when(at == 1, "pianissimo-sv").otherwise("apple-speech")
    )
    stored = F.concat(
        "language", F.lit("="), model, F.lit(";swedish=pianissimo-sv;broken;danish=nothing")
    )
    return models.parse_remembered(
        t.meetings.select("meeting_id", stored.alias("stored")), "stored"
    )


@query("remembered_models", "SELECT meeting_id, language, model FROM remembered", MEMORY)
def _(t):
    return memories(t)


@query(
    "write_remembered_models",
    """SELECT meeting_id, string_agg(language || '=' || model, ';' ORDER BY language || '=' || model)
         AS stored FROM remembered GROUP BY 1""",
    MEMORY,
)
def _(t):
    return models.write_remembered(memories(t), ["meeting_id"])


@query(
    "needed_models",
    """SELECT model FROM (SELECT 'diarization' AS model UNION
         SELECT l.default_model FROM meetings m JOIN languages l ON m.language = l.language
         WHERE l.default_model IN (SELECT model FROM models WHERE is_download))
       WHERE model NOT IN (SELECT DISTINCT model FROM meetings WHERE model IS NOT NULL AND conv_id % 2 = 0)""",
)
def _(t):
    present = t.meetings.where("model IS NOT NULL AND conv_id % 2 = 0").select("model").distinct()
    return models.needed_models(t.meetings, present)


@query(
    "download_remaining",
    """SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS remaining_bytes, count(*) AS items FROM library
       WHERE lang IN ('de', 'fr')""",
)
def _(t):
    state = F.when(F.col("lang") == "de", "queued").when(F.col("lang") == "fr", "downloading")
    queue = t.library.select(F.coalesce(state, F.lit("installed")).alias("state"), "bytes")
    return models.download_remaining(queue)


@query(
    "resolve_locale",
    """SELECT request_id, language, region, locale FROM (
         SELECT q.request_id, q.language, q.region, l.code || '-' || o.region AS locale,
                row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN o.region = q.region THEN 0
                  WHEN o.region = l.home_region THEN 1 ELSE 2 END, o.pos) AS rn
         FROM asked q JOIN languages l ON q.language = l.language JOIN offered o ON o.code = l.code)
       WHERE rn = 1""",
    """
asked AS (
  SELECT meeting_id AS request_id, language,
         CASE conv_id % 4 WHEN 0 THEN 'AT' WHEN 1 THEN 'US' WHEN 2 THEN 'SE' END AS region FROM meetings
),
offered AS (
  SELECT l.code, r.region, r.pos * 100 + l.ord AS pos FROM languages l,
    (VALUES ('AT', 0), ('DE', 1), ('SE', 2), ('PT', 3)) r(region, pos)
  WHERE (l.ord + r.pos) % 3 <> 0
)""",
)
def _(t):
    at = F.col("conv_id") % 4
    asked = t.meetings.select(
        F.col("meeting_id").alias("request_id"),
        "language",
        F.when(at == 0, "AT").when(at == 1, "US").when(at == 2, "SE").alias("region"),
    )
    regions = F.array(
        *[F.struct(F.lit(r).alias("region"), F.lit(i).alias("pos")) for i, r in enumerate(["AT", "DE", "SE", "PT"])]
    )
    offered = (
        languages(t.spark)
        .select("code", "ord", F.inline(regions))
        .where((F.col("ord") + F.col("pos")) % 3 != 0)
        .select((F.col("pos") * 100 + F.col("ord")).alias("locale_pos"), "code", "region")
    )
    return models.resolve_locale(asked, offered)
