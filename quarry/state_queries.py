"""Registered queries of the catalogue's changing state: upserts, results, resume, cache, cells, cards, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, scalars
from .operators import merge, numbering, views
from .plans.mapping import Registry, project
from .queries import _EVENT, _STATUS, _bytes_sql, _t, _with_meta, query, records
from .schema import RECORD
from .sources.store import Store
from .work import work_dir


@query("""select o_orderkey::varchar as id, coalesce(title, 'old') as title, title is not null as there from orders left join (select l_orderkey, arg_max(l_returnflag, l_linenumber) title from lineitem group by 1) on l_orderkey = o_orderkey""")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as edits of their orders: the last of each counts, and orders without lines stay as they are.

    Of lines with one number that which is read first counts, as it stands in its file; lines without a number or a flag say nothing.
    """
    empty = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    existing = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("old").alias("title"), *empty("notes", "description", "referenceCode", "levelOfDescription"))
    lines = _t(spark, sf_dir, "lineitem").where("l_linenumber is not null and l_returnflag is not null")
    incoming = lines.select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("title"), F.col("l_linenumber").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), *empty("notes", "description", "referenceCode", "levelOfDescription"))
    return merge.merge_records(existing, incoming, "line", ("file", "place")).select("id", "title", (F.col("title") != "old").alias("there"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as records in every state."""
    return _with_meta(spark, sf_dir).withColumns({"id": F.col("event_id").cast("string"), "_status": F.expr(_STATUS)})


@query(f"""select e.event_id, case when r.kind < 2 then 'found' else props end as "deepMeta", case r.kind when 0 then null when 1 then 'A' else title end as title,
  case when r.kind < 2 then '' end as language, case when r.kind < 2 then 'complete' when r.kind = 2 then 'error' else {_STATUS.replace("event_id", "e.event_id")} end as status
  from {_EVENT} e left join (select event_id * 2 id, event_id % 3 kind from events) r on r.id = e.event_id""")
def apply_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as results for the records of twice their number: two of three found something, one failed."""
    states = _states(spark, sf_dir)
    kind = F.col("event_id") % 3
    none = {c: F.lit(None).cast("string") for c in ("excerpt", "createdDate", "author", "language", "extent")}
    results = states.select((F.col("event_id") * 2).cast("string").alias("id"), F.lit("found").alias("deepMeta"), F.when(kind == 1, "A").alias("title"), F.when(kind == 2, "bad").alias("error"), *(v.alias(k) for k, v in none.items()))
    return merge.apply_results(states, results).select("event_id", "deepMeta", "title", "language", F.col("_status").alias("status"))


_CACHED = "event_id in (select event_id * 2 from events)"


@query(f"""select event_id, case when {_CACHED} then 'captured' else 'error' end as status, {_CACHED} as has_content,
  case when not ({_CACHED}) then 'Source file no longer cached; add it again to extract its metadata.' end as notes from {_EVENT} where {_STATUS} in ('captured', 'processing')""")
def resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incomplete records after a restart; all events are in the cache under twice their number, so half of the bytes are gone."""
    states = _states(spark, sf_dir)
    cache = states.select((F.col("event_id") * 2).cast("string").alias("id"), F.encode("name", "UTF-8").alias("content"))
    return merge.resume(states, cache).select("event_id", F.col("_status").alias("status"), F.col("content").isNotNull().alias("has_content"), "notes")


@query("select doc_id, case when doc_id in (select doc_id from labels) then md5(text) end as digest from documents")
def cache_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their bytes, which the cache has for labelled documents."""
    docs = _t(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("doc_id").alias("id"))
    cached = docs.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    return merge.restore_bytes(rows, cached).select("doc_id", F.md5("content").alias("digest"))


@query("select doc_id, case when doc_id = 7 then 'new title' end as title, case when doc_id = 7 then 'Series' else 'File' end as level from documents where doc_id <> 9")
def cell_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cells edited and one record deleted, by id."""
    rows = records(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    rows = merge.update_cell(merge.update_cell(rows, "7", "title", "  new title "), "7", "levelOfDescription", "Series")
    return merge.delete_record(rows, "9").select("doc_id", "title", F.col("levelOfDescription").alias("level"))


@query("select page_id, url from pages where split_part(url, '/', 3) = (select split_part(url, '/', 3) from pages where page_id = 1) order by page_id limit 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of a displayed name that several have."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("_seq"), F.col("page_id").cast("string").alias("id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("name"), "url")
    name = pages.where("page_id = 1").first()["name"]
    return merge.first_match(pages, "name", name).select("page_id", "url")


@query("select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' order by o_orderkey limit 1")
def unpack_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first archive of a name; finished orders are the archives here."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("_seq"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", "Archive").otherwise("Document").alias("category"))
    return merge.unpack_target(rows, "1-URGENT").select("o_orderkey")


@query(f"select event_id from {_EVENT} order by title desc, event_id limit 50")
def grid_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the grid by a column, descending."""
    rows = _states(spark, sf_dir).select("event_id", "title")
    return views.page(views.sort_grid(rows, "title", True, "event_id"), 0).select("event_id")


@query("""select o_orderkey, k.key as key, k.position::int as position, k.value as value from (select o_orderkey, unnest([
  {key: 'Author', value: o_orderpriority, position: 0}, {key: 'Title', value: o_orderstatus, position: 1}, {key: 'pages', value: o_custkey::varchar, position: 2}]) k from orders)""")
def sorted_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata entries of all orders, keys in order."""
    meta = F.to_json(F.struct(F.col("o_custkey").alias("pages"), F.col("o_orderstatus").alias("Title"), F.col("o_orderpriority").alias("Author")))
    rows = views.sorted_details(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), meta.alias("deepMeta")))
    return rows.select(F.col("id").alias("o_orderkey"), "key", "position", "value")


@query("""select p_brand as source, k as key, count(*) as records, min(p_partkey) as first_seen from (select p_brand, p_partkey, unnest(case when p_size % 2 = 0 then ['Title', 'pages'] else ['Title'] end) k from part) group by 1, 2""")
def key_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metadata keys each brand's parts bring, and where each is first seen."""
    meta = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("Title"), F.col("p_size").alias("pages")))).otherwise(F.to_json(F.struct(F.col("p_name").alias("Title"))))
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("_seq"), meta.alias("deepMeta"))
    return views.key_catalogue(rows, "source")


@query("select count(distinct o_orderpriority) as batches, sum(2 * length('{\"id\":\"' || o_orderkey || '\",\"name\":\"' || o_orderstatus || '\"}'))::bigint as bytes from orders")
def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("batch_id"))
    return views.storage_usage(rows)


@query("""select c_custkey, r.label as label, r.value as value from (select c_custkey, unnest([{label: 'Title', value: c_name}, {label: 'Duration', value: '1:05'}, {label: 'Sample Rate', value: (c_custkey * 100) || ' Hz'},
  {label: 'Channels', value: case c_custkey % 6 when 1 then 'Mono' when 2 then 'Stereo' else (c_custkey % 6) || 'ch' end}]) r from customer)""")
def audio_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary card of sound metadata; keys that are missing or null don't show."""
    c = F.col("c_custkey")
    meta = F.to_json(F.struct((c * 100).alias("sampleRate"), (c % 6).alias("channels"), F.col("c_name").alias("title"), F.lit("1:05").alias("duration"), F.lit(None).cast("string").alias("artist"), F.lit("x").alias("unknown")))
    rows = views.summary_card(_t(spark, sf_dir, "customer").select(c.alias("id"), meta.alias("deepMeta")), views.AUDIO_CARD)
    return rows.select(F.col("id").alias("c_custkey"), "label", "value")


@query("""select p_partkey, r.label as label, r.value as value from (select p_partkey, unnest([{label: 'Format', value: 'MP4'}, {label: 'Width', value: (p_size * 16)::varchar}, {label: 'Video Codec', value: 'avc1'}, {label: 'Track Count', value: '2'}]) r from part)""")
def video_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.to_json(F.struct(F.lit(2).alias("TrackCount"), F.lit("avc1").alias("VideoCodec"), (F.col("p_size") * 16).alias("Width"), F.lit("MP4").alias("Format")))
    rows = views.summary_card(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), meta.alias("deepMeta")), views.VIDEO_CARD)
    return rows.select(F.col("id").alias("p_partkey"), "label", "value")


@query("""select o_orderkey, case when b < 1024 then b || ' B' when b < 1048576 then printf('%.1f KB', round(b / 1024, 1)) when b < 1073741824 then printf('%.1f MB', round(b / 1048576, 1)) else printf('%.2f GB', round(b / 1073741824, 2)) end as shown,
  'batch-' || strftime(o_orderdate, '%Y-%m-%d') as batch, strftime(o_orderdate, '%b %-d, %Y, %I:%M %p') as day from (select *, ((o_orderkey % 7) * power(10, o_orderkey % 12))::bigint b from orders)""")
def displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache sizes, default batch names and dates as they are shown."""
    rows = _t(spark, sf_dir, "orders").withColumn("b", F.expr("cast((o_orderkey % 7) * power(10, o_orderkey % 12) as bigint)"))
    time = F.col("o_orderdate").cast("timestamp")
    return rows.select("o_orderkey", scalars.format_cache_size(F.col("b")).alias("shown"), scalars.default_batch_name(time).alias("batch"), scalars.format_date(scalars.iso_ms(time)).alias("day"))


@query("""select doc_id, (['txt', 'pdf', 'png', 'txt'])[(doc_id % 4 + 1)::int] as extension, (['Document', 'Document', 'Image', 'Document'])[(doc_id % 4 + 1)::int] as category,
  (['text/plain', 'application/pdf', 'image/png', null])[(doc_id % 4 + 1)::int] as mime from documents""")
def capture_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without an extension or with an unknown one take type, category and MIME from leading bytes."""
    d = F.col("doc_id") % 4
    name = F.when(d == 0, "run.log").when(d == 1, "README").when(d == 2, "shot.unknown").otherwise("a.txt")
    content = F.when(d == 0, F.encode(F.lit("plain words of a log"), "UTF-8")).when(d == 1, F.encode(F.lit("%PDF-1.7 rest"), "UTF-8")).when(d == 2, F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")))
    extension, category, mime = classify.classified(name, content)
    return _t(spark, sf_dir, "documents").select("doc_id", extension.alias("extension"), category.alias("category"), mime.alias("mime"))


@query("""with old as (select doc_id as id, n_chars as size, 0 as cached_at from documents where doc_id in (select doc_id from labels)),
every as (select * from old union all select doc_id, n_chars, doc_id + 1 from documents where doc_id not in (select id from old))
select id, size from (select *, sum(size) over (order by cached_at desc, id desc rows unbounded preceding) s from every) where s <= (select sum(n_chars) // 2 from documents)""")
def cache_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't cached are added; then the oldest go until half of all bytes fit."""
    docs = _t(spark, sf_dir, "documents")
    old = docs.join(_t(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("cachedAt"))
    new = merge.new_files(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), (F.col("doc_id") + 1).alias("cachedAt")), old)
    cap = docs.agg(F.sum("n_chars")).first()[0] // 2
    return numbering.retained(old.unionByName(new), cap).select("id", "size")


@query(f"""select event_id, coalesce(nullif(k, ''), '') as "K", name as "Name", title as "Type" from (select *, title from {_EVENT})""")
def mapping_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping that was created, changed, reordered, duplicated, stored as JSON and made active."""
    registry, first = Registry().create("first")
    mapping = registry.mappings[first]
    for f in mapping.fields:
        if f.key not in ("name", "title", "notes"):
            mapping = mapping.with_field(f.key, included=False)
    mapping = mapping.with_field("notes", label="K", mode="map metadata").with_sources("notes", ["other", "k", "none"]).moved("notes", 1, 0).with_field("title", label="Type")
    registry, copy = registry.update(first, mapping).duplicate(first)
    registry = Registry.from_json(registry.activate(copy).delete(first).rename(copy, "renamed").to_json())
    return project(_with_meta(spark, sf_dir), registry.current(), keep=["event_id"]).select("event_id", "K", "Name", "Type")


@query("select event_id, name, category, 'JSON' as ext, title from (select *, 'Code' category from " + _EVENT + ")")
def column_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with four columns chosen."""
    rows = _states(spark, sf_dir).withColumns({"_status": F.lit("complete"), "_unpacked": F.lit(False), "keep": F.col("event_id")})
    shown = views.grid(rows.withColumn("referenceCode", F.col("event_id").cast("string")), ["refCode", "name", "category", "ext", "title"])
    return shown.select(F.col("refCode").cast("long").alias("event_id"), "name", "category", "ext", "title")


@query("""with b as (select o_orderpriority as name, count(*) as files from orders group by 1)
select name, case when name = '5-LOW' then 'renamed' else name end as shown, files, case when name = '2-HIGH' then files - 1 else files end as exported, case when name = '2-HIGH' then 'changed since export' else 'exported' end as state from b where name <> '3-MEDIUM'""")
def batch_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches created, saved, renamed, exported and deleted in a store; all orders are their records."""
    store = Store(spark, work_dir(spark))
    orders = _t(spark, sf_dir, "orders")
    ids = {}
    for name in sorted(r[0] for r in orders.select("o_orderpriority").distinct().collect()):  # five names
        ids[name] = store.import_records(orders.where(F.col("o_orderpriority") == name).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("name")), name)
        store.record_export(ids[name], store.load(ids[name]).count() - (name == "2-HIGH"))
    store.rename_batch(ids["5-LOW"], "renamed")
    store.delete_batch(ids["3-MEDIUM"])
    rows = views.delete_safety(store.batches(), store.exports())
    named = spark.createDataFrame([(v, k) for k, v in ids.items()], "id string, original string")
    return rows.join(F.broadcast(named), "id").select(F.col("original").alias("name"), F.col("name").alias("shown"), F.col("fileCount").alias("files"), "exported", "state")


@query(f"select doc_id, n, {_bytes_sql('n')} as shown from (select doc_id, strlen(text)::bigint n from documents)")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' records saved as a batch, cleared, saved again and loaded."""
    store = Store(spark, work_dir(spark))
    rows = records(spark, sf_dir)
    batch = store.create_batch("documents")
    store.save(batch, rows)
    store.clear(batch)
    store.save(batch, rows)
    store.activate(batch)
    loaded = store.load(store.active())
    return loaded.select(F.regexp_extract("name", r"doc-(\d+)", 1).cast("long").alias("doc_id"), F.col("size").alias("n"), scalars.format_bytes(F.col("size")).alias("shown"))


@query("""select doc_id, case when doc_id % 2 = 0 then 'captured' else 'error' end as status, case when doc_id % 2 = 0 then md5(text2) end as digest
  from documents d left join (select doc_id * 2 id2, text text2 from documents) c on c.id2 = d.doc_id""")
def batch_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a batch of pages to one of documents; the cache has the texts under twice their number, so odd ones are gone."""
    store = Store(spark, work_dir(spark))
    docs = _t(spark, sf_dir, "documents")
    shape = lambda rows, key: rows.select(key.cast("string").alias("id"), F.lit("captured").alias("_status"))
    second = store.import_records(shape(docs, F.col("doc_id")), "documents")
    store.activate(store.create_batch("pages"))
    store.cache_files(docs.select((F.col("doc_id") * 2).cast("string").alias("id"), F.lit(1).cast("long").alias("size"), F.col("doc_id").alias("cachedAt"), F.encode("text", "UTF-8").alias("content")))
    _, rest = store.switch(shape(_t(spark, sf_dir, "pages"), F.col("page_id")).select("id", "_status", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD.fields if f.name not in ("id", "_status"))), second)
    return rest.select(F.col("id").cast("long").alias("doc_id"), F.col("_status").alias("status"), F.md5("content").alias("digest"))
