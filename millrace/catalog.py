"""Queries over the tables, by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace import vectors


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# ---------------------------------------------------------------- frames
@query("select sha256(text) as key, min(doc_id) as doc_id, count(*) as n from documents group by 1")
def dedup_documents(spark, sf):
    return ops.dedup(table(spark, sf, "documents", "doc_id", "text"), F.sha2("text", 256), "doc_id", count="n")


@query("select sha256(text) as key, min(doc_id) as doc_id, count(*) as n from documents group by 1 order by n desc, doc_id limit 10")
def dedup_sorted_pick(spark, sf):
    return ops.top(ops.dedup(table(spark, sf, "documents", "doc_id", "text"), F.sha2("text", 256), "doc_id", count="n"), 10, F.desc("n"), F.asc("doc_id"))


@query("select event_type, count(*) as n, min(event_id) as first from events group by 1")
def groupby_events(spark, sf):
    return ops.group_by(table(spark, sf, "events", "event_type", "event_id"), "event_type", "event_id")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def sorted_orders(spark, sf):
    return ops.top(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("select user_id, event_id, ts, place from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events) where place < 2")
def pick_first_events(spark, sf):
    rows = ops.pick(table(spark, sf, "events", "user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 0, 2)
    return rows.withColumn("place", F.col("place").cast("long"))


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def p1_last_event(spark, sf):
    return ops.extreme(table(spark, sf, "events", "user_id", "event_id", "ts"), ["user_id"], F.struct("ts", "event_id"), "event_id", "ts")


@query("select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey desc) as r from customer) where r = 1")
def max_per_nation(spark, sf):
    return ops.extreme(table(spark, sf, "customer", "c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.struct("c_acctbal", "c_custkey"), "c_custkey", "c_acctbal")


@query("select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as r from customer) where r = 1")
def min_per_nation(spark, sf):
    return ops.extreme(table(spark, sf, "customer", "c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.struct("c_acctbal", "c_custkey"), "c_custkey", "c_acctbal", largest=False)


@query("select event_id, user_id, cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as cents from events")
def scan_running_sum(spark, sf):
    rows = table(spark, sf, "events", "event_id", "user_id", "ts", "value")
    return ops.running(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.round(F.col("value") * 100).cast("long"), "cents").select("event_id", "user_id", "cents")


@query("select event_id, user_id, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as best from events")
def scan_running_max(spark, sf):
    rows = table(spark, sf, "events", "event_id", "user_id", "ts", "value")
    return ops.running(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value"), "best", F.max).select("event_id", "user_id", "best")


@query("select l_partkey, count(distinct l_suppkey) as n_frames from lineitem group by 1")
def xfcc_parts(spark, sf):
    return ops.count_across(table(spark, sf, "lineitem", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("select l_partkey, count(distinct l_shipmode_) as n_frames from (select l_partkey, l_returnflag as l_shipmode_ from lineitem) group by 1 having count(distinct l_shipmode_) = 3")
def xfcc_intersect(spark, sf):
    return ops.keep(ops.count_across(table(spark, sf, "lineitem", "l_partkey", "l_returnflag"), "l_partkey", "l_returnflag"), "n_frames = 3")


@query("select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as names from nation group by 1")
def sep_nations(spark, sf):
    return ops.joined(table(spark, sf, "nation", "n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], "n_nationkey", "n_name", ",", "names")


@query("select conv_id, string_agg(role, ' ' order by turn) as roles from conversations group by 1")
def sbs_roles(spark, sf):
    return ops.joined(table(spark, sf, "conversations", "conv_id", "turn", "role"), ["conv_id"], "turn", "role", " ", "roles")


@query("select conv_id, turn, first_role from (select conv_id, turn, first_value(role) over (partition by conv_id order by turn) as first_role, row_number() over (partition by conv_id order by turn) as r from conversations) where r > 1")
def pop_first_role(spark, sf):
    return ops.attach(table(spark, sf, "conversations", "conv_id", "turn", "role"), ["conv_id"], F.col("turn"), "role", "first_role").select("conv_id", "turn", "first_role")


@query("select x.n_regionkey, x.n_name as a, y.n_name as b from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_name < y.n_name")
def urn_combinations(spark, sf):
    return ops.combine(table(spark, sf, "nation", "n_regionkey", "n_name"), ["n_regionkey"], "n_name")


@query("select x.n_regionkey, x.n_name as a, y.n_name as b from nation x join nation y on x.n_regionkey = y.n_regionkey")
def urn_products(spark, sf):
    return ops.combine(table(spark, sf, "nation", "n_regionkey", "n_name"), ["n_regionkey"], "n_name", False)


@query("select n_regionkey, cast(p - 1 as integer) as \"column\", string_agg(substr(n_name, p, 1), '' order by n_nationkey) as text from (select *, unnest(range(1, length(n_name) + 1)) as p from nation) group by 1, 2")
def transpose_names(spark, sf):
    return ops.transpose(table(spark, sf, "nation", "n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"], "n_nationkey", "n_name")


@query("select user_id, b, count(*) as n from (select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 10 as b from events) group by 1, 2")
def group_of_ten(spark, sf):
    rows = ops.pick(table(spark, sf, "events", "user_id", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return rows.groupBy("user_id", F.floor(F.col("place") / 10).alias("b")).agg(F.count("*").alias("n"))


@query("select count(*) as n, cast(sum(cast(round(l_extendedprice * l_discount * 100) as bigint)) as bigint) as cents from lineitem where l_shipdate >= timestamp '1994-01-01' and l_shipdate < timestamp '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
def iff_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem", "l_shipdate", "l_discount", "l_quantity", "l_extendedprice")
    kept = ops.keep(rows, "l_shipdate >= timestamp '1994-01-01' and l_shipdate < timestamp '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return kept.agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")).alias("cents"))


@query("select doc_id from documents where length(text) between 1000 and 2000")
def iffc_documents(spark, sf):
    return ops.keep(table(spark, sf, "documents", "doc_id", "text"), F.length("text").between(1000, 2000)).select("doc_id")


@query("select doc_id from documents where contains(text, 'license')")
def iffs_documents(spark, sf):
    return ops.keep(table(spark, sf, "documents", "doc_id", "text"), F.contains("text", F.lit("license"))).select("doc_id")


@query("select doc_id, len(regexp_extract_all(text, '[0-9]+')) as n from documents where len(regexp_extract_all(text, '[0-9]+')) >= 2")
def iffx_documents(spark, sf):
    n = F.regexp_count("text", F.lit("[0-9]+")).cast("long")
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", n.alias("n")).filter("n >= 2")


@query("select c_mktsegment, c_custkey, c_name from (select *, row_number() over (partition by c_mktsegment order by c_custkey) as r, count(*) over (partition by c_mktsegment) as c from customer) where r > c - 3")
def pick_last_customers(spark, sf):
    rows = ops.pick(table(spark, sf, "customer", "c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment"], [F.desc("c_custkey")], 0, 3)
    return rows.drop("place")


# ---------------------------------------------------------------- strings and codecs
def _unit(name: str, source: tuple[str, str, str], sql: str, unit: str, reverse: bool = False, as_text: bool = True, **args):
    """A query that applies a unit to a column of a table: key, and out as text."""
    tbl, key, column = source

    def run(spark, sf):
        rows = ops.each(table(spark, sf, tbl, key, column), unit, column, "out", reverse, **args)
        return rows.select(key, (F.decode("out", "UTF-8") if as_text else F.lower(F.hex("out"))).alias("out"))

    run.__name__ = name
    return query(sql or None)(run)


_PART = ("part", "p_partkey", "p_name")
_CUSTOMER = ("customer", "c_custkey", "c_name")
_DOC = ("documents", "doc_id", "text")
_unit("hex_encode", _PART, "select p_partkey, hex(p_name) as out from part", "hex", True)
_unit("hex_decode", ("documents", "doc_id", "text"), "select doc_id, lower(hex(from_hex(left(d, len(d) // 2 * 2)))) as out from (select doc_id, regexp_replace(text, '[^0-9a-fA-F]+', '', 'g') as d from documents)", "hex", False, False)
_unit("b64_encode", _DOC, "select doc_id, to_base64(encode(text)) as out from documents", "b64", True)
_unit("upper_case", _PART, "select p_partkey, upper(p_name) as out from part", "cupper")
_unit("lower_case", _CUSTOMER, "select c_custkey, lower(c_name) as out from customer", "clower")
_unit("swap_case", _CUSTOMER, "select c_custkey, translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') as out from customer", "cswap")
_unit("rot13", _PART, "select p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') as out from part", "rot")
_unit("atbash_names", _PART, "select p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'zyxwvutsrqponmlkjihgfedcbaZYXWVUTSRQPONMLKJIHGFEDCBA') as out from part", "atbash")
_unit("reverse_names", _PART, "select p_partkey, reverse(p_name) as out from part", "rev")
_unit("append_text", _CUSTOMER, "select c_custkey, c_name || '!' as out from customer", "cca", data_=b"!")
_unit("prepend_text", _CUSTOMER, "select c_custkey, '> ' || c_name as out from customer", "ccp", data_=b"> ")
_unit("replace_text", _PART, "select p_partkey, replace(p_name, 'a', '4') as out from part", "repl", search=b"a", replace=b"4")
_unit("map_letters", _PART, "select p_partkey, translate(p_name, 'aeiou', 'AEIOU') as out from part", "map", index=b"aeiou", image=b"AEIOU")
_unit("resub_blanks", _DOC, "select doc_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') as out from documents", "resub", regex=r"\s+", subst=b" ")
_unit("md5_text", _DOC, "select doc_id, md5(text) as out from documents", "md5", text=True)
_unit("sha1_text", _DOC, "select doc_id, sha1(text) as out from documents", "sha1", text=True)
_unit("sha256_text", _DOC, "select doc_id, sha256(text) as out from documents", "sha256", text=True)
_unit("md5_twice", _PART, "select p_partkey, md5(from_hex(md5(p_name))) as out from part", "md5", text=True, reps=2)
_unit("urlfix_pages", ("pages", "page_id", "url"), "select page_id, regexp_replace(trim(url), '[;?#].*$', '') as out from pages", "urlfix")
_unit("pad_names", _CUSTOMER, "select c_custkey, rpad(c_name, cast(ceil(length(c_name) / 16.0) * 16 as integer), '.') as out from customer", "pad", width=16, padding=b".")
_unit("trim_text", _PART, "select p_partkey, trim(p_name, 'ab') as out from part", "trim", junk=(b"a", b"b"))
_unit("edit_text", _CUSTOMER, "select c_custkey, '#' || substr(c_name, 2) as out from customer", "edit", offset=0, string=b"#")
_unit("terminate_text", _CUSTOMER, "select c_custkey, split_part(c_name, '#', 1) as out from customer", "terminate", sentinel=b"#")
_unit("stretch_text", _PART, "select p_partkey, regexp_replace(p_name, '(.)', '\\1\\1', 'g') as out from part", "stretch", count=(2,))
_unit("url_encode", ("pages", "page_id", "url"), "select page_id, replace(replace(url_encode(url), '%2F', '/'), '%5C', chr(92)) as out from pages", "url", True)
_unit("xor_constant", _PART, "select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: printf('%02x', xor(ascii(substr(p_name, i, 1)), 32))), '') as out from part", "xor", False, False, argument=0x20)
_unit("add_constant", _PART, "select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: printf('%02x', (ascii(substr(p_name, i, 1)) + 1) % 256)), '') as out from part", "add", False, False, argument=1)
_unit("neg_bytes", _PART, "select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: printf('%02x', 255 - ascii(substr(p_name, i, 1)))), '') as out from part", "neg", False, False)
_unit("u16_encode", _PART, "select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: printf('%02x00', ascii(substr(p_name, i, 1)))), '') as out from part", "u16", True, False)
_unit("crc32_text", _DOC, "", "crc32", text=True)
_unit("aes_round_trip", _CUSTOMER, "", "aes", True, False, key=b"0123456789abcdef")
_unit("zl_compress", _DOC, "", "zl", True, False)


@query("select p_partkey, p_name as out from part")
def codec_round_trips(spark, sf):
    rows = table(spark, sf, "part", "p_partkey", "p_name").withColumn("out", F.col("p_name").cast("binary"))
    for name in ("b64", "hex", "b32", "b85", "z85", "b58", "url", "netbios"):
        rows = ops.each(ops.each(rows, name, "out", reverse=True), name, "out")
    return rows.select("p_partkey", F.decode("out", "UTF-8").alias("out"))


@query("select c_custkey, c_name as out from customer")
def cipher_round_trips(spark, sf):
    rows = table(spark, sf, "customer", "c_custkey", "c_name").withColumn("out", F.col("c_name").cast("binary"))
    for name, args in (("aes", {"key": b"0123456789abcdef"}), ("rc4", {"key": b"key"}), ("xtea", {"key": b"0123456789abcdef"}), ("chacha20", {"key": b"k" * 32})):
        rows = ops.each(ops.each(rows, name, "out", reverse=True, **args), name, "out", **args)
    return rows.select("c_custkey", F.decode("out", "UTF-8").alias("out"))


@query("select doc_id, text as out from documents")
def compression_round_trips(spark, sf):
    rows = table(spark, sf, "documents", "doc_id", "text").withColumn("out", F.col("text").cast("binary"))
    for name, args in (("zl", {}), ("bz2", {}), ("lzma", {"level": 1}), ("zstd", {})):
        rows = ops.each(ops.each(rows, name, "out", reverse=True, **args), name, "out")
    return rows.select("doc_id", F.decode("out", "UTF-8").alias("out"))


# ---------------------------------------------------------------- generators
@query("select p_partkey, cast(i as integer) as pos, substr(p_name, i * 8 + 1, 8) as part from (select *, unnest(range(0, cast(ceil(length(p_name) / 8.0) as bigint))) as i from part)")
def chop_names(spark, sf):
    return ops.chop(table(spark, sf, "part", "p_partkey", "p_name"), "p_name", 8, ["p_partkey"])


@query("select doc_id, cast(i - 1 as integer) as pos, l[i] as part from (select doc_id, regexp_split_to_array(text, '\\r?\\n') as l, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) as i from documents)")
def resplit_lines(spark, sf):
    return ops.split(table(spark, sf, "documents", "doc_id", "text"), "text", "\r?\n", ["doc_id"])


@query("select p_partkey, substr(p_name, i + 1, 3) as gram, cast(min(i) as integer) as \"offset\" from (select *, unnest(range(0, length(p_name) - 2)) as i from part) group by 1, 2")
def ngrams_names(spark, sf):
    return ops.ngrams(table(spark, sf, "part", "p_partkey", "p_name"), "p_name", 3, ["p_partkey"])


@query("select doc_id, cast(i - 1 as integer) as pos, l[i] as match from (select doc_id, regexp_extract_all(text, '[0-9]{2,}') as l, unnest(range(1, len(regexp_extract_all(text, '[0-9]{2,}')) + 1)) as i from documents)")
def rex_digits(spark, sf):
    found = table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([0-9]{2,})"), 1)).alias("pos", "match"))
    return found


@query("select doc_id, cast(i - 1 as integer) as pos, l[i] as match from (select doc_id, regexp_extract_all(text, '[A-Z][a-z]{7,}') as l, unnest(range(1, len(regexp_extract_all(text, '[A-Z][a-z]{7,}')) + 1)) as i from documents)")
def rex_unit_words(spark, sf):
    rows = ops.generate(table(spark, sf, "documents", "doc_id", "text"), "rex", "text", ["doc_id"], regex=r"[A-Z][a-z]{7,}")
    return rows.select("doc_id", "pos", F.decode("data", "UTF-8").alias("match"))


@query("select page_id, l[i] as href, count(*) as n from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as l, unnest(range(1, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) + 1)) as i from pages) group by 1, 2")
def html_links(spark, sf):
    found = table(spark, sf, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query()
def xtp_emails(spark, sf):
    rows = ops.generate(table(spark, sf, "documents", "doc_id", "text"), "xtp", "text", ["doc_id"], {"pattern": "string"}, pattern=("email",))
    return rows.select("doc_id", "pos", F.decode("data", "UTF-8").alias("email"), "pattern")


@query()
def xtp_urls(spark, sf):
    rows = ops.generate(table(spark, sf, "pages", "page_id", "url"), "xtp", "url", ["page_id"], pattern=("url",))
    return rows.select("page_id", "pos", F.decode("data", "UTF-8").alias("url"))


@query()
def xthtml_titles(spark, sf):
    rows = ops.generate(table(spark, sf, "pages", "page_id", "html"), "xthtml", "html", ["page_id"], {"path": "string"}, paths=("*title",))
    return rows.select("page_id", "pos", "path", F.decode("data", "UTF-8").alias("title"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def xj0_props(spark, sf):
    return table(spark, sf, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select p_partkey, cast(i as integer) as pos, substr(p_name, i + 1, 1) as letter from (select *, unnest(range(0, length(p_name))) as i from part)")
def chop_unit_letters(spark, sf):
    rows = ops.generate(table(spark, sf, "part", "p_partkey", "p_name"), "chop", "p_name", ["p_partkey"], size=1)
    return rows.select("p_partkey", "pos", F.decode("data", "UTF-8").alias("letter"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as fixed from orders")
def datefix_orders(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderdate").withColumn("raw", F.date_format("o_orderdate", "yyyy:MM:dd'T'HH:mm:ss"))
    return ops.each(rows, "datefix", "raw", "fixed").select("o_orderkey", F.decode("fixed", "UTF-8").alias("fixed"))


@query("select r_regionkey, r_regionkey || ',' || r_name as line from region")
def csv_encode(spark, sf):
    rows = table(spark, sf, "region", "r_regionkey", "r_name")
    return rows.select("r_regionkey", F.to_csv(F.struct("r_regionkey", "r_name")).alias("line"))


@query("select n_name, n_regionkey, length(n_name) as size, md5(n_name) as md5, sha256(n_name) as sha256 from nation")
def cm_nations(spark, sf):
    from millrace.plans import ChunkFrame

    rows = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    frame = ChunkFrame.from_table(rows, "n_name", "n_nationkey", None, n_regionkey="n_regionkey")
    found = frame.table("n_regionkey", "size", "md5", "sha256")
    as_text = lambda c: F.decode(c, "UTF-8")
    return found.select(as_text("data").alias("n_name"), as_text("n_regionkey").cast("int").alias("n_regionkey"), as_text("size").cast("long").alias("size"), as_text("md5").alias("md5"), as_text("sha256").alias("sha256"))


@query("select n_regionkey, n_name from (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_name desc) as r from nation) where r <= 2")
def pipeline_sorted_pick(spark, sf):
    from millrace.plans import ChunkFrame, load_pipeline

    frame = ChunkFrame.from_table(table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), "n_name", "n_nationkey", "n_regionkey", n_regionkey="n_regionkey")
    found = load_pipeline(spark, "sorted | pick :2").run(frame).table("n_regionkey")
    return found.select(F.decode("n_regionkey", "UTF-8").cast("int").alias("n_regionkey"), F.decode("data", "UTF-8").alias("n_name"))


@query("select conv_id, count(distinct role) as n from conversations group by 1")
def pipeline_dedup(spark, sf):
    from millrace.plans import ChunkFrame, load_pipeline

    frame = ChunkFrame.from_table(table(spark, sf, "conversations", "conv_id", "turn", "role"), "role", "turn", "conv_id")
    found = load_pipeline(spark, "dedup | cupper | cca !").run(frame).df
    return found.groupBy(F.col("path")[0].cast("long").alias("conv_id")).agg(F.count("*").alias("n"))

def _bytes(name: str, unit: str, formula: str, **args):
    """A query that applies a unit of blocks to part names; ``formula`` gives each byte from b (and its index i)."""
    sql = f"select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: printf('%02x', {formula.replace('b', 'ascii(substr(p_name, i, 1))')})), '') as out from part"
    _unit(name, _PART, sql, unit, False, False, **args)


_bytes("sub_constant", "sub", "(b + 255) % 256", argument=1)
_bytes("shl_one", "shl", "(b * 2) % 256", argument=1)
_bytes("shr_one", "shr", "b // 2", argument=1)
_bytes("rotl_one", "rotl", "(b * 2) % 256 + b // 128", argument=1)
_bytes("rotr_one", "rotr", "b // 2 + (b % 2) * 128", argument=1)
_bytes("xor_key", "xor", "xor(b, case i % 3 when 1 then 107 when 2 then 101 else 121 end)", argument=b"key")
_bytes("alu_sum", "alu", "(b + i - 1) % 256", operator="B+K")
_bytes("bitrev_bytes", "bitrev", "(b % 2) * 128 + (b // 2 % 2) * 64 + (b // 4 % 2) * 32 + (b // 8 % 2) * 16 + (b // 16 % 2) * 8 + (b // 32 % 2) * 4 + (b // 64 % 2) * 2 + b // 128")
_LIST = "list_transform(range(1, length(p_name) + 1), lambda i: cast(ascii(substr(p_name, i, 1)) as bigint))"
_unit("djb2_text", _PART, f"select p_partkey, printf('%08x', list_reduce(list_prepend(5381::bigint, {_LIST}), lambda h, x: (h * 33 + x) % 4294967296)) as out from part", "djb2", text=True)
_unit("fnv1a_text", _PART, f"select p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::bigint, {_LIST}), lambda h, x: (xor(h, x) * 16777619) % 4294967296)) as out from part", "fnv1a", text=True)
_unit("fnv1_text", _PART, f"select p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::bigint, {_LIST}), lambda h, x: xor((h * 16777619) % 4294967296, x))) as out from part", "fnv1", text=True)
_unit("netbios_encode", _PART, "select p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: chr(cast(65 + ascii(substr(p_name, i, 1)) // 16 as integer)) || chr(cast(65 + ascii(substr(p_name, i, 1)) % 16 as integer))), '') as out from part", "netbios", True)
_unit("byteswap_pairs", _PART, "select p_partkey, regexp_replace(left(p_name, length(p_name) // 2 * 2), '(.)(.)', '\\2\\1', 'g') as out from part", "byteswap", size=2)
_unit("snip_middle", _CUSTOMER, "select c_custkey, substr(c_name, 3, 5) as out from customer", "snip", slices=(slice(2, 7),))
_unit("pack_numbers", _CUSTOMER, "select c_custkey, printf('%02x', cast(regexp_extract(c_name, '[0-9]+') as bigint) % 256) as out from customer", "pack", False, False)
_unit("defang_urls", ("pages", "page_id", "url"), "", "defang")
_unit("htmlesc_encode", _PART, "select p_partkey, replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as out from part", "htmlesc", True)
_unit("vigenere_names", _PART, "", "vigenere", True, key=b"lemon")
_unit("pbkdf2_keys", _CUSTOMER, "", "pbkdf2", False, False, size=16, salt=b"salt", iter=10)
_unit("peek_names", _CUSTOMER, "", "peek")
_unit("sm4_round_trip", _CUSTOMER, "", "sm4", True, False, key=b"0123456789abcdef")


def _pipe(name: str, source: tuple[str, str, str, str | None], text: str, sql: str, *names: str):
    """A query that runs a pipeline over a table: (table, data, order, frame); variables are columns of text."""
    tbl, data, order, frame = source

    def run(spark, sf):
        from millrace.plans import ChunkFrame, load_pipeline

        columns = [*dict.fromkeys(c for c in (data, order, frame) if c)]
        rows = ChunkFrame.from_table(table(spark, sf, tbl, *columns), data, order, frame, key=frame or order)
        found = load_pipeline(spark, text).run(rows).table("key", *names)
        return found.select(*[F.decode(n, "UTF-8").alias(n) for n in ("key", *names)], F.decode("data", "UTF-8").alias("out"))

    run.__name__ = name
    return query(sql or None)(run)


_NATION = ("nation", "n_name", "n_nationkey", "n_regionkey")
_pipe("pipe_put_eat", _NATION, "put n size | eat n", "select cast(n_regionkey as varchar) as key, cast(length(n_name) as varchar) as out from nation")
_pipe("pipe_swap", _NATION, "put n | cupper | cca ! | swap n", "select cast(n_regionkey as varchar) as key, upper(n_name) || '!' as n, n_name as out from nation", "n")
_pipe("pipe_pf", _NATION, "pf {key}:{}:{size}", "select cast(n_regionkey as varchar) as key, n_regionkey || ':' || n_name || ':' || length(n_name) as out from nation")
_pipe("pipe_reduce", _NATION, "reduce cca[var:t]", "select cast(n_regionkey as varchar) as key, string_agg(n_name, '' order by n_nationkey desc) as out from nation group by 1")
_pipe("pipe_loop", _NATION, "loop 3 cca[!]", "select cast(n_regionkey as varchar) as key, n_name || '!!!' as out from nation")
_pipe("pipe_iff", _NATION, "iff size -gt 6", "select cast(n_regionkey as varchar) as key, n_name as out from nation where length(n_name) > 6")
_pipe("pipe_iffx", _NATION, "iffx A.*A", "select cast(n_regionkey as varchar) as key, n_name as out from nation where regexp_matches(n_name, 'A.*A')")
_pipe("pipe_iffp", _NATION, "iffp [A-H].*", "select cast(n_regionkey as varchar) as key, n_name as out from nation where regexp_full_match(n_name, '[A-H].*')")
_pipe("pipe_iff_hidden", _NATION, "iff -r size -gt 6 | cca !", "select cast(n_regionkey as varchar) as key, case when length(n_name) > 6 then n_name || '!' else n_name end as out from nation")
_pipe("pipe_rep", _NATION, "rep 2", "select cast(n_regionkey as varchar) as key, n_name as out from nation, range(2)")
_pipe("pipe_chop", _NATION, "chop 3", "select cast(n_regionkey as varchar) as key, substr(n_name, i * 3 + 1, 3) as out from (select *, unnest(range(0, cast(ceil(length(n_name) / 3.0) as bigint))) as i from nation)")
_pipe("pipe_snip", _NATION, "snip 1:3", "select cast(n_regionkey as varchar) as key, substr(n_name, 2, 2) as out from nation")
_pipe("pipe_queues", _NATION, "qf first | qb last", "select cast(n_regionkey as varchar) as key, n_name as out from nation union all select null, x from (select distinct n_regionkey from nation), (values ('first'), ('last')) v(x)")
_pipe("pipe_sep", _NATION, "sep -", "select cast(n_regionkey as varchar) as key, n_name as out from nation union all select null, '-' from (select n_regionkey, unnest(range(count(*) - 1)) from nation group by 1)")
_pipe("pipe_scan", _NATION, "put n size | scan m=m+n", "select cast(n_regionkey as varchar) as key, cast(sum(length(n_name)) over (partition by n_regionkey order by n_nationkey rows unbounded preceding) as varchar) as m, n_name as out from nation", "m")
_pipe("pipe_dedup_count", ("conversations", "role", "turn", "conv_id"), "dedup -c", "select cast(conv_id as varchar) as key, cast(count(*) as varchar) as count, role as out from conversations group by conv_id, role", "count")
_pipe("pipe_max", _NATION, "max", "select cast(n_regionkey as varchar) as key, max(n_name) as out from nation group by 1")
_pipe("pipe_pick_ends", _NATION, "pick 0 -1", "select cast(n_regionkey as varchar) as key, n_name as out from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as a, row_number() over (partition by n_regionkey order by n_nationkey desc) as b from nation) where a = 1 or b = 1")
_pipe("pipe_transpose", _NATION, "transpose", "select cast(n_regionkey as varchar) as key, string_agg(substr(n_name, p, 1), '' order by n_nationkey) as out from (select *, unnest(range(1, length(n_name) + 1)) as p from nation) group by n_regionkey, p")
_pipe("pipe_rex", _NATION, "rex [AEIOU]+", "select cast(n_regionkey as varchar) as key, unnest(regexp_extract_all(n_name, '[AEIOU]+')) as out from nation")
_pipe("pipe_resplit", _NATION, "resplit A", "select cast(n_regionkey as varchar) as key, unnest(string_split(n_name, 'A')) as out from nation")
_pipe("pipe_codecs", _NATION, "hex -R | b64 -R | b64 | hex | rev", "select cast(n_regionkey as varchar) as key, reverse(n_name) as out from nation")
_pipe("pipe_hashes", _NATION, "md5 | sha256 -t", "select cast(n_regionkey as varchar) as key, sha256(from_hex(md5(n_name))) as out from nation")
_pipe("pipe_crypto", _NATION, "rc4 -R key | rc4 key | aes -R h:00112233445566778899aabbccddeeff | aes h:00112233445566778899aabbccddeeff", "select cast(n_regionkey as varchar) as key, n_name as out from nation")


def _vectors(family: str) -> None:
    _QUERIES[f"vectors_{family}"] = lambda spark, sf: vectors.results(spark, family)
    _SQL[f"vectors_{family}"] = vectors.sql(family)


for _family in vectors.FAMILIES:
    _vectors(_family)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents by hash with their numbers, the most frequent first: dedup -c, sorted and pick in one plan."""
    return dedup_sorted_pick(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
