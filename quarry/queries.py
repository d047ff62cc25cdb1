"""The registered queries of the catalogue, each with SQL that gives the same rows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, headers, markup, scalars
from .functions.textstats import text_stats
from .functions.values import CATEGORIES, FIELDS
from .operators import merge, numbering, sinks, views
from .plans import normalize
from .plans.mapping import Mapping, apply_mapping, project
from .plans.metadata import entries, gathered
from .sources.archives import unzip
from .sources.chunks import parts
from .sources.files import capture

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text files."""
    docs = _t(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    return docs.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.timestamp_millis(F.col("doc_id") * 1000).alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the documents, with metadata of their own; doc_id stays beside."""
    docs = files(spark, sf_dir)
    return capture(docs, keep=["doc_id"])


_HASH = """'f_' || lower(to_base(abs(list_reduce(list_concat([0::bigint], list_transform(string_split({x}, ''), lambda c: unicode(c)::bigint)),
  lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)), 36))"""
_PATH = "source || '/' || lang || '/doc-' || doc_id || '.txt'"
_SIZE = "strlen(text)::bigint"
_ISO = "strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"
_ID = _HASH.format(x=f"({_PATH} || '-' || {_SIZE} || '-' || (doc_id * 1000))")
_RECORDS = f"""(select doc_id, {_ID} id, 'doc-' || doc_id || '.txt' name, {_PATH} path, {_SIZE} size, 'application/octet-stream' "type",
  'txt' extension, 'Document' category, {_ISO} lastmodified from documents)"""


@query(f"""select doc_id, id, name, path, size, "type", extension, category, lastmodified as "lastModified", 'File' as "levelOfDescription", 'local' as source, 'captured' as status from {_RECORDS}""")
def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", "id", "name", "path", "size", "type", "extension", "category", "lastModified", "levelOfDescription", "source", F.col("_status").alias("status"))


_NAME = "regexp_replace(string_split(url, '/')[-1], '[?#].*$', '')"


@query(f"select page_id, name, case when contains(name, '.') then lower(string_split(name, '.')[-1]) else '' end extension from (select page_id, {_NAME} name from pages)")
def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace(F.substring_index("url", "/", -1), "[?#].*$", "")
    return _t(spark, sf_dir, "pages").select("page_id", name.alias("name"), classify.file_extension(name).alias("extension"))


_KNOWN = [e for names in CATEGORIES.values() for e in names.split()] + ["", "zzz", "log"]
_CATEGORY_SQL = "case " + " ".join(f"when e in ({', '.join(repr(x) for x in names.split())}) then '{c}'" for c, names in CATEGORIES.items()) + " else 'Other' end"


@query(f"select category, count(*) as n, sum(n_chars)::bigint as n_chars from (select {_CATEGORY_SQL} category, n_chars from (select ({_KNOWN!r})[(doc_id % {len(_KNOWN)} + 1)::int] e, n_chars from documents)) group by category")
def classify_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.element_at(F.array(*(F.lit(x) for x in _KNOWN)), (F.col("doc_id") % len(_KNOWN) + 1).cast("int"))
    return _t(spark, sf_dir, "documents").groupBy(classify.category(e).alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


_MAGIC = [("25504446", "pdf"), ("D0CF11E0", "doc"), ("504B0304" + "00" * 26 + b"word/x".hex(), "docx"), ("504B0304" + "00" * 26 + b"xl/x".hex(), "xlsx"), ("504B0304" + "00" * 30 + b"a.txt".hex(), "zip"), ("FFD8FFE0", "jpg"), ("89504E47", "png"), ("47494638", "gif"), ("49492A00", "tiff"), ("38425053", "psd"), ("0000001866747970" + b"heic".hex(), "heic"), ("0000001866747970" + b"isom".hex(), "mp4"), ("424D", "bmp"), ("5249464600000000" + b"WEBP".hex(), "webp"), ("5249464600000000" + b"WAVE".hex(), "wav"), ("664C6143", "flac"), ("4F676753", "ogg"), ("FFFB9000", "mp3"), ("7B5C727466", "rtf"), ("00010203040506070809", None)]


@query(f"select doc_id, ({[k for _, k in _MAGIC]!r})[(doc_id % {len(_MAGIC)} + 1)::int] as detected from documents".replace("None", "null"))
def magic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*(F.lit(x) for x, _ in _MAGIC)), (F.col("doc_id") % len(_MAGIC) + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode("text", "UTF-8"))
    return _t(spark, sf_dir, "documents").select("doc_id", classify.magic(content).alias("detected"))


_PLACES = ["docs/a.txt", "__MACOSX/a.txt", "x/._a.txt", "x/.DS_Store", "Thumbs.db", "x/desktop.ini", "x/", ".Trashes", "x/.fseventsd", ".Spotlight-V100", "x/readme", "MACOSX/y.txt"]
_PLACE_SQL = f"({_PLACES!r})[(doc_id % {len(_PLACES)} + 1)::int]"


@query(f"""select doc_id, p as place from (select doc_id, {_PLACE_SQL} p from documents) where not (p like '%\\_\\_MACOSX/%' escape '\\' or p like '%/'
  or string_split(p, '/')[-1] like '.\\_%' escape '\\' or string_split(p, '/')[-1] in ('.DS_Store', 'Thumbs.db', 'desktop.ini', '.Trashes', '.fseventsd', '.Spotlight-V100'))""")
def os_artifact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.element_at(F.array(*(F.lit(x) for x in _PLACES)), (F.col("doc_id") % len(_PLACES) + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", place.alias("place")).where(~classify.is_os_artifact(F.col("place")))


def _bytes_sql(x: str) -> str:
    out = f"case when {x} = 0 then '0 B' when {x} < 1024 then {x}::bigint || ' B'"
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        shown = f"printf('%.1f', round({x}::double / {1024**i}, 1)) || ' {unit}'"
        out += f" when {x} < {1024 ** (i + 1)} then {shown}" if unit != "TB" else f" else {shown} end"
    return out


@query(f"select o_orderkey, {_bytes_sql('b')} as shown from (select o_orderkey, ((o_orderkey % 7) * power(10, o_orderkey % 13))::bigint b from orders)")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ((F.col("o_orderkey") % 7) * F.pow(F.lit(10), F.col("o_orderkey") % 13)).cast("long")
    return _t(spark, sf_dir, "orders").select("o_orderkey", scalars.format_bytes(b).alias("shown"))


@query(r"""select doc_id, case when contains(text, chr(13) || chr(10)) then 'CRLF (Windows)' when contains(text, chr(13)) then 'CR (Classic Mac)' when contains(text, chr(10)) then 'LF (Unix/macOS)' else 'None (single line)' end as "lineEndings",
  len(string_split(t, chr(10)))::bigint as "lineCount", len(regexp_extract_all(t, '\S+'))::bigint as "wordCount", length(t)::bigint as "charCount",
  length(regexp_replace(t, '\s', '', 'g'))::bigint as "charCountNoSpaces", nullif(strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), 0)::bigint as "nonAsciiBytes",
  ends_with(t, chr(10)) as "endsWithNewline", list_max(list_transform(string_split(t, chr(10)), lambda x: length(x)))::bigint as "longestLine"
  from (select doc_id, text, regexp_replace(text, '\r\n?', chr(10), 'g') t from documents)""")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _t(spark, sf_dir, "documents").select("doc_id", text_stats(F.encode("text", "UTF-8")).alias("s"))
    return stats.select("doc_id", *(F.col(f"s.{c}") for c in ("lineEndings", "lineCount", "wordCount", "charCount", "charCountNoSpaces", "nonAsciiBytes", "endsWithNewline", "longestLine")))


@query("""select doc_id, length(e)::bigint as n, md5(e) as digest from (select doc_id, case when length(t) > 3000 then left(t, 3000) || chr(10) || '[…truncated]' else t end e
  from (select doc_id, repeat(text, (1 + doc_id % 3)::int) t from documents))""")
def excerpt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("repeat(text, cast(1 + doc_id % 3 as int))")
    cut = _t(spark, sf_dir, "documents").select("doc_id", scalars.excerpt_of_text(text, 3000).alias("e"))
    return cut.select("doc_id", F.length("e").cast("long").alias("n"), F.md5("e").alias("digest"))


@query(r"""select page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '') as title, len(regexp_extract_all(html, '<[a-zA-Z]'))::bigint as elements from pages""")
def markup_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = markup.svg_fields(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", fields["SVGTitle"].alias("title"), fields["ElementCount"].alias("elements"))


@query(r"""select doc_id, length(t)::bigint as n, md5(t) as digest from (select doc_id, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') t from documents)""")
def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = scalars.escape_html(F.col("text"))
    xml = F.concat(F.lit('<w:document><w:body><w:p w:rsid="1"><w:r><w:t>'), F.replace(xml, F.lit("\n"), F.lit("</w:t></w:r></w:p><w:p><w:r><w:t>")), F.lit("</w:t></w:r></w:p></w:body></w:document>"))
    found = _t(spark, sf_dir, "documents").select("doc_id", markup.docx_text(xml).alias("t"))
    return found.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def _be(x: Column, n: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * n, "0"))


def _le(x: Column, n: int = 4) -> Column:
    h = F.lpad(F.hex(x.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n)))))


def _raw(text: str) -> Column:
    return F.lit(text.encode())


_SIDES = "p_partkey % 4000 + 1 as w, p_size * 37 as h"
_RATIO = "(w // gcd(w, h)) || ':' || (h // gcd(w, h)) as ratio, printf('%.1f', round(w * h / 1000000.0, 1)) || ' MP' as megapixels"


def _sides() -> tuple[Column, Column]:
    return F.col("p_partkey") % 4000 + 1, F.col("p_size").cast("long") * 37


@query(f"select p_partkey, w::bigint as width, h::bigint as height, case when p_partkey % 2 = 0 then 'RGB' else 'RGBA' end as colour, case when p_partkey % 2 = 0 then 24 else 32 end::bigint as bits, {_RATIO} from (select p_partkey, {_SIDES} from part)")
def png_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = _sides()
    ihdr = F.concat(_be(w), _be(h), F.unhex(F.when(F.col("p_partkey") % 2 == 0, "0802000000").otherwise("0806000000")))
    x = headers.png_header(ihdr)
    return _t(spark, sf_dir, "part").select("p_partkey", x["Width"].alias("width"), x["Height"].alias("height"), x["ColorType"].alias("colour"), x["BitsPerPixel"].cast("long").alias("bits"), x["AspectRatio"].alias("ratio"), x["Megapixels"].alias("megapixels"))


@query(f"select p_partkey, w::bigint as width, h::bigint as height, 'BITMAPINFOHEADER' as dib, 24::bigint as bits, 'RGB' as space, {_RATIO} from (select p_partkey, {_SIDES} from part)")
def bmp_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = _sides()
    content = F.concat(_raw("BM"), F.unhex(F.lit("00" * 12)), _le(F.lit(40)), _le(w), _le(F.lit(2**32) - h), F.unhex(F.lit("01001800" + "00" * 24)))
    x = headers.bmp_header(content)
    return _t(spark, sf_dir, "part").select("p_partkey", x["Width"].alias("width"), x["Height"].alias("height"), x["DIBHeader"].alias("dib"), x["BitsPerPixel"].alias("bits"), x["ColorSpace"].alias("space"), x["AspectRatio"].alias("ratio"), x["Megapixels"].alias("megapixels"))


@query("select p_partkey, 'PSD' as format, (p_size % 5)::bigint as channels, (p_partkey % 4000 + 1)::bigint as width, (p_size * 37)::bigint as height, 'CMYK' as mode from part")
def psd_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = _sides()
    content = F.concat(_raw("8BPS"), F.unhex(F.lit("0001000000000000")), _be(F.col("p_size") % 5, 2), _be(h), _be(w), F.unhex(F.lit("00080004")))
    x = headers.psd_header(content)
    return _t(spark, sf_dir, "part").select("p_partkey", x["Format"].alias("format"), x["Channels"].alias("channels"), x["Width"].alias("width"), x["Height"].alias("height"), x["ColorMode"].alias("mode"))


_META = """case c_custkey % 5 when 0 then '{"pageCount":0,"pages":"0","Author":"' || c_name || '"}' when 1 then '{"CreationDate":"d' || c_custkey || '","pageCount":' || c_custkey || '}'
  when 2 then '{"author":"' || c_name || '","slides":"","sheetCount":3}' when 3 then '{"Title":"","title":"t","encrypted":false}' else null end"""


@query(f"""select c_custkey, case when c_custkey % 5 = 1 then 'd' || c_custkey end as created, case when c_custkey % 5 in (0, 2) then c_name end as author, case when c_custkey % 5 = 3 then 't' end as title,
  case c_custkey % 5 when 0 then '0' when 1 then c_custkey::varchar when 2 then '3' end as extent from customer""")
def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(_META).alias("deepMeta"))
    return normalize.normalised(rows).select("c_custkey", F.col("createdDate").alias("created"), "author", "title", "extent")


def _with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of events, their props as metadata."""
    ev = _t(spark, sf_dir, "events")
    text = lambda c: F.lit(c)
    return ev.select("event_id", F.concat(F.lit("e-"), F.col("event_id").cast("string"), F.lit(".json")).alias("name"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("user_id").alias("size"), text("application/json").alias("type"), text("json").alias("extension"), text("Code").alias("category"), F.col("event_type").alias("title"), text("File").alias("levelOfDescription"), F.col("props").alias("deepMeta"), text("local").alias("source"), *(F.lit(None).cast("string").alias(c) for c in ("lastModified", "createdDate", "author", "description", "language", "extent", "referenceCode", "url", "notes", "excerpt")))


_EVENT = f"""(select event_id, 'e-' || event_id || '.json' name, 'user/' || user_id path, user_id size, event_type title, props, json_extract_string(props, '$.k') k, {_bytes_sql("user_id")} shown from events)"""


@query("select event_id, " + ", ".join({"name": "name", "path": "path", "category": "'Code'", "extension": "'json'", "type": "'application/json'", "sizeRaw": "size::varchar", "sizeFormatted": "shown", "lastModified": "'null'", "title": "coalesce(title, '')", "levelOfDescription": "'File'", "source": "'local'", "deepMeta": "coalesce(props, '')"}.get(k, "''") + f' as "{v}"' for k, v in FIELDS.items()) + f" from {_EVENT}")
def mapping_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(_with_meta(spark, sf_dir), keep=["event_id"])


def _only(mapping: Mapping, *keys: str) -> Mapping:
    for f in mapping.fields:
        if f.key not in keys and not f.custom:
            mapping = mapping.with_field(f.key, included=False)
    return mapping


@query(f"""select event_id, name as "File name", coalesce(title, '') as "Title" from {_EVENT}""")
def mapping_rename_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(_with_meta(spark, sf_dir), _only(Mapping("m").with_field("name", label="File name"), "name", "title"), ["event_id"])


@query(f"""select event_id, coalesce(nullif(k, ''), '') as "K", coalesce(nullif(k, ''), '') as "Fallback", '' as "Missing" from {_EVENT}""")
def mapping_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping("m").with_field("notes", label="K", mode="map metadata", metadata_key="k")
    m = m.with_field("author", label="Fallback", mode="map metadata", metadata_key="none", fallbacks=(None, "k"))
    m = m.with_field("url", label="Missing", mode="map metadata", metadata_key="none")
    return project(_with_meta(spark, sf_dir), _only(m, "notes", "author", "url"), ["event_id"])


@query(f"""select event_id, 'Archive' as "Level", '<' || name || '>' as "Name", '' as "Notes", 'none' as "Extra" from {_EVENT}""")
def mapping_fixed_affix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping("m").with_field("levelOfDescription", mode="fixed value", fixed="Archive").with_field("name", prefix="<", suffix=">").with_field("notes", prefix="n: ")
    return project(_with_meta(spark, sf_dir), _only(m.with_custom("Extra", mode="fixed value", fixed="none"), "levelOfDescription", "name", "notes"), ["event_id"])


@query(f"""select event_id, coalesce(k, '') as notes, 'T: ' || title as title, size * 10 as size, '' as author from {_EVENT}""")
def mapping_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Mapping("m").with_field("notes", mode="map metadata", metadata_key="k").with_field("title", prefix="T: ").with_field("sizeRaw", suffix="0")
    return apply_mapping(_with_meta(spark, sf_dir), m).select("event_id", "notes", "title", "size", "author")


def _field_sql(x: str) -> str:
    return f"""case when {x} like '%,%' or {x} like '%"%' or contains({x}, chr(10)) then '"' || replace({x}, '"', '""') || '"' else {x} end"""


@query(f"select page_id, md5({_field_sql('url')} || ',' || {_field_sql('html')}) as digest from pages")
def csv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sinks.csv_lines(_t(spark, sf_dir, "pages"), ["url", "html"], ["page_id"])
    return lines.select("page_id", F.md5("line").alias("digest"))


@query("""select doc_id, '{"id":"' || doc_id || '","lang":"' || lang || '","source":"' || source || '"}' as line from documents""")
def json_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    return sinks.json_rows(rows, ["id", "lang", "source"], ["doc_id"])


@query("""with e as (select doc_id::varchar id, 'n' || doc_id notes, case when doc_id % 3 = 0 then 'Series' else 'File' end lvl, 'old' title from documents),
n as (select (doc_id * 2)::varchar id, case when doc_id % 4 = 0 then 'new' else '' end notes, 'File' lvl, 'new' title from documents)
select coalesce(n.id, e.id) as id, case when n.id is null then e.notes when n.notes = '' and e.notes is not null then e.notes else n.notes end as notes,
  case when n.id is null or e.lvl <> 'File' then e.lvl else n.lvl end as "levelOfDescription", coalesce(n.title, e.title) as title from e full join n on e.id = n.id""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as records, and all as edits of records with twice their number: half of these are new."""
    docs, d = _t(spark, sf_dir, "documents"), F.col("doc_id")
    rows = lambda id_, notes, level, title: docs.select(id_.cast("string").alias("id"), notes.alias("notes"), level.alias("levelOfDescription"), F.lit(title).alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("description", "referenceCode")))
    existing = rows(d, F.concat(F.lit("n"), d.cast("string")), F.when(d % 3 == 0, "Series").otherwise("File"), "old")
    incoming = rows(d * 2, F.when(d % 4 == 0, "new").otherwise(""), F.lit("File"), "new")
    return merge.merge_records(existing, incoming, "title").select("id", "notes", "levelOfDescription", "title")


@query("""with e as (select doc_id::varchar id, source notes, case when lang = 'en' then 'Series' else 'File' end lvl, 'old' title from documents),
n as (select doc_id::varchar id, case when quality = 1 then 'good' else '' end notes, 'File' lvl, 'toxic ' || toxic title from labels)
select coalesce(n.id, e.id) as id, case when n.id is null then e.notes when n.notes = '' and e.notes is not null then e.notes else n.notes end as notes,
  case when n.id is null or e.lvl <> 'File' then e.lvl else n.lvl end as "levelOfDescription", case when n.id is null then e.title else n.title end as title from e full join n on e.id = n.id""")
def merge_upsert_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as existing records, all labels as edits of them."""
    shape = lambda rows, notes, level, title: rows.select(F.col("doc_id").cast("string").alias("id"), notes.alias("notes"), level.alias("levelOfDescription"), title.alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("description", "referenceCode")))
    existing = shape(_t(spark, sf_dir, "documents"), F.col("source"), F.when(F.col("lang") == "en", "Series").otherwise("File"), F.lit("old"))
    incoming = shape(_t(spark, sf_dir, "labels"), F.when(F.col("quality") == 1, "good").otherwise(""), F.lit("File"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")))
    return merge.merge_records(existing, incoming, "title").select("id", "notes", "levelOfDescription", "title")


@query("select doc_id as id, n_chars from documents where doc_id not in (select doc_id from labels)")
def cache_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.new_files(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("select doc_id as id, quality from labels where doc_id not in (select doc_id * 3 from documents)")
def cache_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels as the cache, all documents as records with three times their number."""
    kept = _t(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("id"))
    return merge.orphans(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), kept)


@query("select doc_id as id, n_chars from documents where doc_id not in (select page_id from pages)")
def cache_orphans_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the cache, all pages as records."""
    cache = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return merge.orphans(cache, _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id")))


@query("""select doc_id, case when doc_id % 4 = 0 then doc_id + 1 else (select max(doc_id + 1) from documents where doc_id % 4 = 0) + row_number() over (partition by doc_id % 4 = 0 order by doc_id) end as seq from documents""")
def assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 1).alias("_seq"))
    return numbering.assign_seq(rows, [F.col("doc_id")]).select("doc_id", F.col("_seq").alias("seq"))


@query("""with r as (select doc_id, source, case when doc_id % 7 = 0 then 'Temp/' || source || '/' || printf('%07d', doc_id) end code from documents),
m as (select source, max(regexp_extract(code, '/(\\d+)$', 1)::bigint) top from r where code is not null group by 1)
select doc_id, coalesce(code, 'Temp/' || source || '/' || printf('%07d', coalesce(top, 0) + row_number() over (partition by source, code is null order by doc_id))) as code from r left join m using (source)""")
def reference_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    code = F.when(F.col("doc_id") % 7 == 0, F.format_string("Temp/%s/%07d", "source", "doc_id"))
    return numbering.assign_reference_codes(docs.select("doc_id", "source", code.alias("referenceCode")), [F.col("doc_id")], "source").select("doc_id", F.col("referenceCode").alias("code"))


@query("select id, size, cached_at from (select doc_id as id, n_chars as size, doc_id // 3 as cached_at, sum(n_chars) over (order by doc_id // 3 desc, doc_id desc rows unbounded preceding) s from documents) where s <= 1000000")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.floor(F.col("doc_id") / 3).alias("cachedAt"))
    return numbering.retained(cache, 1_000_000).select("id", "size", F.col("cachedAt").alias("cached_at"))


@query("select event_id, event_type from events order by coalesce(nullif(event_id % 1000, 5), 0) desc, event_id limit 50 offset 50")
def newest_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("_seq", F.nullif(F.col("event_id") % 1000, F.lit(5)))
    return views.page(views.newest_first(rows, "event_id"), 1).select("event_id", "event_type")


@query("select doc_id, source, lang from documents where contains(lower(source), 'src1') or contains(lower(lang), 'src1') or contains(lower(text), 'src1') or contains(doc_id::varchar, 'src1')")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search(_t(spark, sf_dir, "documents"), "SRC1", ["doc_id", "source", "lang", "text"]).select("doc_id", "source", "lang")


@query(f"""select event_id, '' as "refCode", name, path, 'Code' as category, 'JSON' as ext, shown as size, case event_id % 3 when 0 then '⏳' when 1 then '⚠' else '' end as author, title, 'view,meta' as actions from {_EVENT}""")
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_meta(spark, sf_dir).withColumns({"_status": F.element_at(F.array(F.lit("captured"), F.lit("error"), F.lit("complete")), (F.col("event_id") % 3 + 1).cast("int")), "_unpacked": F.lit(False)})
    shown = views.grid(rows.withColumn("excerpt", F.col("event_id").cast("string")), ["refCode", "name", "path", "category", "ext", "size", "author", "title", "actions", "excerpt"])
    return shown.withColumn("event_id", F.col("excerpt").cast("long")).drop("excerpt")


@query("select o_orderpriority as batch_id, count(*) as files, sum(o_custkey)::bigint as bytes, max(o_orderkey) as top_seq from orders group by 1")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch_id"), F.col("o_custkey").alias("size"), F.col("o_orderkey").alias("_seq"))
    return views.batch_summary(rows)


@query("""with b as (select c_custkey::varchar id, c_custkey % 4 n from customer), e as (select o_custkey::varchar id, arg_max(o_orderkey % 4, o_orderkey) last, count(*) k from orders group by 1)
select b.id, n::bigint as files, coalesce(k, 0) as exports, case when n = 0 then 'empty' when last is null then 'never exported' when last <> n then 'changed since export' else 'exported' end as state, n = 0 or coalesce(last = n, false) as safe from b left join e using (id)""")
def delete_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 4).alias("fileCount"))
    exports = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("batch_id"), F.col("o_orderkey").alias("date"), (F.col("o_orderkey") % 4).alias("fileCount"))
    return views.delete_safety(batches, exports).select("id", F.col("fileCount").alias("files"), "exports", "state", "safe")


@query("select user, string_agg(t || ': ' || n, ', ' order by n desc, t) as histogram from (select user_id % 10 as user, event_type t, count(*) n from events group by 1, 2) group by 1")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.histogram_text(_t(spark, sf_dir, "events").withColumn("user", F.col("user_id") % 10), "event_type", ["user"])


@query("select event_id as id, 'k' as key, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def detail_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.details(_t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("deepMeta")))


_STATUS = "case event_id % 4 when 0 then 'captured' when 1 then 'processing' when 2 then 'complete' else 'error' end"


@query(f"select {_STATUS} as status, count(*) as rows from events group by 1")
def status_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("_status", F.expr(_STATUS))
    return views.status_counts(rows).select(F.col("_status").alias("status"), "rows")


@query("select count(*) filter (event_id % 4 > 1) as done, count(*) as total, floor(count(*) filter (event_id % 4 > 1) / count(*) * 100 + 0.5)::bigint as percent from events")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.progress(_t(spark, sf_dir, "events").withColumn("_status", F.expr(_STATUS)))


@query("select count(*) as files, sum(n_chars)::bigint as bytes from documents")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cache_stats(_t(spark, sf_dir, "documents").select(F.col("n_chars").alias("size"), F.encode("text", "UTF-8").alias("content")))




@query("select doc_id, member, length(text)::bigint as n, md5(text) as digest from (select doc_id, text, 'zip-' || doc_id || '/a/doc.txt' member from documents)")
def unzip_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped as stored archives by built-in functions, then expanded."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    name, size = b"a/doc.txt", F.octet_length("b")
    entry = lambda body: F.concat(_le(F.lit(20), 2), F.unhex(F.lit("0000" * 2 + "00000000" + "00000000")), _le(size), _le(size), _le(F.lit(len(name)), 2), F.unhex(F.lit("0000")), body)
    local = F.concat(F.lit(b"PK\3\4"), entry(F.lit(name)), F.col("b"))
    central = F.concat(F.lit(b"PK\1\2"), _le(F.lit(20), 2), entry(F.unhex(F.lit("00" * 14))), F.lit(name))
    end = F.concat(F.lit(b"PK\5\6"), F.unhex(F.lit("00000000" + "0100" * 2)), _le(F.octet_length(central)), _le(F.octet_length(local)), F.unhex(F.lit("0000")))
    archives = docs.select("doc_id", F.concat(F.lit("zip-"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), F.concat(local, central, end).alias("content"))
    found = unzip(archives, "doc_id").withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    return found.select("doc_id", F.col("path").alias("member"), F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in a partition for each core at least: a table's few bytes make whole files."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _extracted(spark: SparkSession, sf_dir: str, table: str, key: str, extension: str, content: Column, *paths: tuple[str, str]) -> DataFrame:
    """Metadata of files built from a table's columns: a column for each (name, key of the metadata)."""
    rows = _spread(_t(spark, sf_dir, table)).select(key, F.lit(extension).alias("extension"), content.alias("content"))
    found = gathered(entries(parts(rows, key), key, [extension]), key)
    return found.select(key, *(F.get_json_object("deepMeta", f"$['{k}']").alias(n) for n, k in paths))


def _sized(kind: bytes, data: Column, order=_le) -> Column:
    return F.concat(F.lit(kind), order(F.octet_length(data)), data)


@query("""select c_custkey, '2' as channels, ((c_custkey % 40 + 8) * 1000)::varchar as rate, c_mktsegment as artist, (t // 60) || ':' || printf('%02d', t % 60) as duration
  from (select *, (c_custkey * 400000) // ((c_custkey % 40 + 8) * 4000) t from customer)""")
def wav_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 400,000 bytes of sound a key, which four bytes can't count from key 10,738 on: these are RF64 files."""
    size = F.col("c_custkey") * 400_000
    long, none = size >= 2**32 - 1, F.unhex(F.lit("00" * 12))
    rate = (F.col("c_custkey") % 40 + 8) * 1000
    fmt = F.concat(F.unhex(F.lit("01000200")), _le(rate), _le(rate * 4), F.unhex(F.lit("04001000")))
    name = F.concat(F.encode("c_mktsegment", "UTF-8"), F.unhex(F.lit("00")))
    name = F.when(F.octet_length(name) % 2 == 1, F.concat(name, F.unhex(F.lit("00")))).otherwise(name)
    info = F.concat(_raw("INFO"), _sized(b"IART", name))
    sizes = F.concat(_le(size + F.octet_length(name) + 92, 8), _le(size, 8), none)  # the first is that of all that follows it
    head = F.when(long, F.concat(F.lit(b"RF64\xff\xff\xff\xffWAVE"), _sized(b"ds64", sizes))).otherwise(F.lit(b"RIFF\0\0\0\0WAVE"))
    content = F.concat(head, _sized(b"fmt ", fmt), _sized(b"LIST", info), _raw("data"), _le(F.when(long, 2**32 - 1).otherwise(size)))
    return _extracted(spark, sf_dir, "customer", "c_custkey", "wav", content, ("channels", "channels"), ("rate", "sampleRate"), ("artist", "artist"), ("duration", "duration"))


@query("select c_custkey, c_name as title, c_mktsegment as artist, 'ID3v2.3' as version from customer")
def id3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda kind, text: F.concat(F.lit(kind), _be(F.octet_length(text) + 1), F.unhex(F.lit("000003")), F.encode(text, "UTF-8"))
    frames = F.concat(frame(b"TIT2", F.col("c_name")), frame(b"TPE1", F.col("c_mktsegment")))
    n = F.octet_length(frames)
    safe = F.concat(F.unhex(F.lit("0000")), _be(F.shiftright(n, 7), 1), _be(n.bitwiseAND(127), 1))
    content = F.concat(_raw("ID3"), F.unhex(F.lit("030000")), safe, frames)
    return _extracted(spark, sf_dir, "customer", "c_custkey", "mp3", content, ("title", "title"), ("artist", "artist"), ("version", "id3Version"))


@query("select p_partkey, (p_partkey % 4000 + 1)::varchar as width, (p_size * 37)::varchar as height, p_name as author, p_brand as comment from part")
def png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = _sides()
    chunk = lambda kind, data: F.concat(_be(F.octet_length(data)), F.lit(kind), data, F.unhex(F.lit("00000000")))
    text = lambda key, value: chunk(b"tEXt", F.concat(F.lit(key + b"\0"), F.encode(value, "UTF-8")))
    content = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), chunk(b"IHDR", F.concat(_be(w), _be(h), F.unhex(F.lit("0802000000")))), text(b"Author", F.col("p_name")), text(b"Comment", F.col("p_brand")), chunk(b"IDAT", F.lit(b"x")))
    return _extracted(spark, sf_dir, "part", "p_partkey", "png", content, ("width", "Width"), ("height", "Height"), ("author", "PNG:Author"), ("comment", "PNG:Comment"))


@query("select o_orderkey, 'MP4' as format, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') as created, case when o_custkey = 0 then null when o_custkey >= 3600 then (o_custkey // 3600) || ':' || printf('%02d', o_custkey // 60 % 60) || ':' || printf('%02d', o_custkey % 60) else (o_custkey // 60)::varchar || ':' || printf('%02d', o_custkey % 60) end as duration from orders")
def mp4_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda kind, data: F.concat(_be(F.octet_length(data) + 8), F.lit(kind), data)
    made = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 2_082_844_800
    mvhd = F.concat(F.unhex(F.lit("00000000")), _be(made), _be(made), _be(F.lit(1000)), _be(F.col("o_custkey") * 1000), F.unhex(F.lit("00" * 80)))
    content = F.concat(box(b"ftyp", _raw("isom")), box(b"moov", box(b"mvhd", mvhd)))
    return _extracted(spark, sf_dir, "orders", "o_orderkey", "mp4", content, ("format", "Format"), ("created", "CreationDate"), ("duration", "Duration"))


@query("select s_suppkey, s_name as title, (s_nationkey + 1)::varchar as pages, 'Ann' as author from supplier")
def rtf_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(r"{\rtf1\ansi{\info{\title "), F.col("s_name"), F.lit(r"}{\author Ann}{\nofpages"), (F.col("s_nationkey") + 1).cast("string"), F.lit(r"}}\pard x}"))
    x = markup.rtf_fields(text, markup.rtf_info(text))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", x["title"].alias("title"), x["pageCount"].cast("string").alias("pages"), x["author"].alias("author"))


@query("select s_suppkey, s_name as title, strftime(make_timestamp(2000 + s_nationkey, 3, 4, 0, 0, 0), '%Y-%m-%dT%H:%M:%S.000Z') as created, 2::bigint as pages, s_name as keywords from supplier")
def pdf_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("%PDF-1.4\n<</Title ("), F.col("s_name"), F.lit(")/CreationDate (D:"), (F.col("s_nationkey") + 2000).cast("string"), F.lit("0304)>> /Type /Pages /Type /Page /Type/Page <x:xmpmeta><dc:subject><rdf:li>"), F.col("s_name"), F.lit("</rdf:li></dc:subject></x:xmpmeta>"))
    x = markup.pdf_fields(text, markup.xmp_packet(text))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", x["Title"].alias("title"), x["CreationDate"].alias("created"), x["pageCount"].alias("pages"), x["Keywords"].alias("keywords"))


@query("select c_custkey, c_name as title, c_mktsegment as company, c_mktsegment as client from customer")
def office_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = F.concat(F.lit("<x><dc:title><b>"), F.col("c_name"), F.lit("</b></dc:title></x>"))
    app = F.concat(F.lit("<Properties><Company>"), F.col("c_mktsegment"), F.lit("</Company></Properties>"))
    custom = F.concat(F.lit('<Properties><property name="Client"><vt:lpwstr>'), F.col("c_mktsegment"), F.lit("</vt:lpwstr></property></Properties>"))
    return _t(spark, sf_dir, "customer").select("c_custkey", markup.office_fields(core, markup.CORE)["title"].alias("title"), markup.office_fields(app, markup.APP)["company"].alias("company"), markup.custom_properties(custom)["Client"].alias("client"))


from . import document_queries, state_queries  # noqa: E402, F401  # register further queries
