"""What a reader of the catalogue sees: grid rows, search, pages, details, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import action_flags
from ..functions.scalars import channels_shown, format_bytes, format_date, humanised, preview, sample_rate_shown
from ..functions.values import PAGE_ROWS, PREVIEW

GRID = ("refCode", "name", "path", "category", "ext", "mime", "size", "modified", "created", "author", "title", "description", "level", "language", "extent", "source", "notes", "excerpt", "actions", "delete")
HIDDEN = ("mime", "description", "level", "language", "extent", "source", "excerpt")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def grid(records: DataFrame, visible: list[str] | None = None, has_file: Column | None = None) -> DataFrame:
    """Display rows with the visible columns; pending and failed rows show a mark.

    A record without bytes at hand (``has_file`` false) offers neither view nor unpack.
    """
    visible = [c for c in GRID if c not in HIDDEN] if visible is None else visible
    pending = F.when(F.col("_status").isin("captured", "processing"), "⏳").when(F.col("_status") == "error", "⚠").otherwise("")
    or_pending = lambda c: F.when(_text(c) == "", pending).otherwise(F.col(c))
    meta = F.coalesce(F.col("deepMeta"), F.lit("{}")) != "{}"
    cells = {
        "refCode": _text("referenceCode"), "name": F.col("name"),
        "path": F.when(F.col("path") == F.col("name"), "").otherwise(_text("path")),
        "category": _text("category"), "ext": F.upper(_text("extension")), "mime": _text("type"),
        "size": format_bytes(F.col("size")), "modified": format_date(F.col("lastModified")),
        "created": F.when(_text("createdDate") == "", pending).otherwise(format_date(F.col("createdDate"))),
        "author": or_pending("author"), "title": or_pending("title"), "description": _text("description"),
        "level": _text("levelOfDescription"), "language": _text("language"), "extent": _text("extent"),
        "source": _text("source"), "notes": _text("notes"), "excerpt": preview(_text("excerpt")),
        "actions": action_flags(F.col("extension"), F.lit(True) if has_file is None else has_file, meta, F.col("_unpacked")),
        "delete": F.lit(""),
    }
    return records.select(*(cells[c].alias(c) for c in visible))


def search(rows: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in one of whose visible columns ``text`` occurs, whatever the case."""
    hit = F.lit(False)
    for c in rows.columns if columns is None else columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    return rows.where(hit)


def newest_first(records: DataFrame, *ties: str) -> DataFrame:
    return records.orderBy(F.coalesce("_seq", F.lit(0)).desc(), *ties)


def page(ordered: DataFrame, number: int, rows: int = PAGE_ROWS) -> DataFrame:
    """Page 0, 1, ... of an ordered table."""
    return ordered.offset(number * rows).limit(rows)


def details(records: DataFrame) -> DataFrame:
    """id, key, value of each metadata entry, long values cut for display."""
    entries = F.explode(F.from_json("deepMeta", "map<string,string>")).alias("key", "value")
    cut = F.when(F.length("value") > PREVIEW, F.concat(F.left("value", F.lit(PREVIEW)), F.lit("..."))).otherwise(F.col("value"))
    return records.select("id", entries).where("value is not null").select("id", "key", cut.alias("value"))


def sorted_details(records: DataFrame) -> DataFrame:
    """id, position, key and value of each metadata entry, keys in order of their characters."""
    meta = F.from_json("deepMeta", "map<string,string>")
    pairs = F.array_sort(F.map_entries(F.map_filter(meta, lambda k, v: v.isNotNull())))
    rows = records.select("id", F.posexplode(pairs).alias("position", "e"))
    return rows.select("id", "position", F.col("e.key").alias("key"), preview(F.col("e.value"), "...").alias("value"))


#: What the summary cards of sound and film show, in order.
AUDIO_CARD = ("title", "artist", "album", "year", "genre", "track", "composer", "albumArtist", "duration", "bitrate", "sampleRate", "channels", "format", "encoder", "copyright", "bpm")
VIDEO_CARD = ("Format", "Duration", "Width", "Height", "Rotation", "VideoCodec", "AudioCodec", "CreationDate", "MajorBrand", "TrackCount")


def summary_card(records: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """id, position, label and value of the card's keys that a record has."""
    value = lambda k: F.get_json_object("deepMeta", f"$['{k}']")
    shown = {k: value(k) for k in keys} | {"sampleRate": sample_rate_shown(value("sampleRate")), "channels": channels_shown(value("channels").try_cast("long"))}
    rows = F.array(*(F.struct(F.lit(i).alias("position"), humanised(F.lit(k)).alias("label"), shown[k].alias("value")) for i, k in enumerate(keys)))
    return records.select("id", F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("r")).select("id", "r.*")


def sort_grid(rows: DataFrame, column: str, descending: bool = False, *ties: str) -> DataFrame:
    """Display rows ordered by any visible column."""
    return rows.orderBy(F.col(column).desc() if descending else F.col(column).asc(), *ties)


def key_catalogue(records: DataFrame, source: str = "extension") -> DataFrame:
    """Which metadata keys each source brings, in how many records, and the sequence number of the first."""
    keys = F.explode(F.map_keys(F.from_json("deepMeta", "map<string,string>"))).alias("key")
    return records.select(source, "_seq", keys).groupBy(source, "key").agg(F.count("*").alias("records"), F.min("_seq").alias("first_seen"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("_status").agg(F.count("*").alias("rows"))


def progress(records: DataFrame) -> DataFrame:
    """done, total and percent (rounded half up) of a table."""
    done = F.count_if(~F.col("_status").isin("captured", "processing"))
    total = F.count("*")
    return records.agg(done.alias("done"), total.alias("total"), F.when(total > 0, F.floor(done / total * 100 + 0.5)).otherwise(0).cast("long").alias("percent"))


def batch_summary(records: DataFrame) -> DataFrame:
    """Of each batch: files, bytes, highest sequence number."""
    return records.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("_seq").alias("top_seq"))


def cache_stats(cache: DataFrame) -> DataFrame:
    size = F.coalesce(F.nullif(F.col("size"), F.lit(0)), F.octet_length("content").cast("long"), F.lit(0))
    return cache.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def storage_usage(records: DataFrame) -> DataFrame:
    """Batches, and bytes of their records as UTF-16 JSON."""
    text = F.to_json(F.struct(*(c for c in records.columns if c != "batch_id")))
    return records.agg(F.countDistinct("batch_id").alias("batches"), F.coalesce(F.sum(2 * F.length(text)), F.lit(0)).cast("long").alias("bytes"))


def delete_safety(batches: DataFrame, exports: DataFrame) -> DataFrame:
    """Whether each batch may go: it is empty, or its last export held as many files."""
    last = exports.groupBy("batch_id").agg(F.max_by("fileCount", "date").alias("exported"), F.count("*").alias("exports"))
    rows = batches.join(last, batches["id"] == last["batch_id"], "left").drop("batch_id")
    state = F.when(F.col("fileCount") == 0, "empty").when(F.col("exported").isNull(), "never exported").when(F.col("exported") != F.col("fileCount"), "changed since export").otherwise("exported")
    return rows.withColumns({"exports": F.coalesce("exports", F.lit(0)), "state": state, "safe": state.isin("empty", "exported")})


def histogram_text(rows: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """Counts of ``kind`` as ``type: n`` joined, most frequent first (then by name)."""
    counts = rows.groupBy(*(by or []), kind).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(kind).alias("t"))))  # one entry a kind
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["t"], F.lit(": "), (-p["o"]).cast("string"))), ", ")
    return counts.groupBy(*(by or [])).agg(joined.alias("histogram"))
