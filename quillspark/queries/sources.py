"""Queries: reading formats, pages and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import nested
from ..plans.adapters import Views
from ..plans.roster import Roster
from ..plans.shared import new_path
from ..sources import jsonmaps, npz, readers

roster = Roster()
query = roster.query


@query("tsv_permissive", "select source, target, votes from (select string_split(line, chr(9)) as p, split_part(line, chr(9), 1) as source, split_part(line, chr(9), 2) as target, try_cast(split_part(line, chr(9), 3) as int) as votes from (select case conv_id % 4 when 0 then role || chr(9) || conv_id when 1 then role || chr(9) || conv_id || chr(9) || 'many' else role || chr(9) || conv_id || chr(9) || (turn - 1) end as line from conversations)) where len(p) >= 3 and votes >= 1")
def tsv_permissive(v: Views) -> DataFrame:
    role, conv, tab = F.col("role"), F.col("conv_id").cast("string"), F.lit("\t")
    line = F.when(F.col("conv_id") % 4 == 0, F.concat(role, tab, conv)).when(F.col("conv_id") % 4 == 1, F.concat(role, tab, conv, tab, F.lit("many"))).otherwise(F.concat(role, tab, conv, tab, (F.col("turn") - 1).cast("string")))
    return readers.votes_tsv(v.table("conversations").select(line.alias("line")))


@query("html_cells", r"select page_id, pos, trim(regexp_replace(regexp_replace(cell, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as cell from (select page_id, unnest(list) as cell, unnest(range(len(list)))::int as pos from (select page_id, regexp_extract_all(html, '(?s)<(?:li|td|th|h1|h2)>(.*?)</(?:li|td|th|h1|h2)>', 1) as list from pages))")
def html_cells(v: Views) -> DataFrame:
    """The text of headings, list items and table cells; tables with merged rows are read by ``html_tables``."""
    cells = v.table("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<(?:li|td|th|h1|h2)>(.*?)</(?:li|td|th|h1|h2)>"), F.lit(1))).alias("pos", "cell"))
    return cells.select("page_id", "pos", F.trim(F.regexp_replace(F.regexp_replace("cell", "<[^>]+>", ""), r"\s+", " ")).alias("cell"))


@query(
    "html_tables",
    r"""with turns as (select conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t, turn % 5 as kind, lead(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) over w as next from conversations window w as (partition by conv_id order by turn))
select conv_id as key, 'Book ' || (conv_id % 7) as book, 'Chapter ' || conv_id as chapter, (turn + 1)::int as verse, case when kind = 1 then '' else t end as new,
  case when kind = 1 then t || case when t <> '' and coalesce(next, '') <> '' then ' ' else '' end || coalesce(next, '') else role end as old
from turns where kind in (0, 1, 3) and (kind <> 1 or t <> '' or coalesce(next, '') <> '')""",
)
def html_tables(v: Views) -> DataFrame:
    """Conversations as pages with a table: turns are rows of four cells, of an old text only, that go on with the row before, of three cells, or without a number."""
    cell = lambda *x: F.concat(*(F.concat(F.lit("<td>"), c, F.lit(" </td>\n")) for c in x))
    text, number, none = tx.escape_html(F.coalesce("text", F.lit(""))), (F.col("turn") + 1).cast("string"), F.lit("")
    kind = F.col("turn") % 5
    row = F.when(kind == 0, cell(number, text, number, F.col("role"))).when(kind == 1, cell(none, none, number, text)).when(kind == 2, cell(none, none, none, text)).when(kind == 3, cell(number, text, F.col("role"))).otherwise(cell(F.lit("x"), text, F.lit("1"), text))
    pages = v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<tr>"), row, F.lit("</tr>")).alias("row")))).alias("rows"))
    head = F.concat(F.lit("<html><h1>Book "), (F.col("conv_id") % 7).cast("string"), F.lit("</h1><h2> Chapter "), F.col("conv_id").cast("string"), F.lit("</h2><table><tr><th>No.</th></tr>"))
    html = F.concat(head, F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.lit("</table></html>"))
    return readers.html_verses(pages.select("conv_id", html.alias("html")), "conv_id", "html").drop("pos")


@query(
    "reference_lines",
    """select l_orderkey as file, 'book' || (l_orderkey % 4) || ':' || l_orderkey || ':1' as source, 'book' || (l_partkey % 4) as book, r::int as chapter, l_quantity::int as vs, (l_quantity::int + l_suppkey % 2)::int as ve,
  case when r > 3 then 'reciprocal' else 'thematic' end as type, case when r > 3 then 'reciprocal' else 'topic ' || (l_orderkey % 7) end as topic, case when r > 3 then 'note ' || l_suppkey else '' end as note
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as r from lineitem) where l_orderkey % 5 <> 0 and l_partkey % 5 <> 0""",
)
def reference_lines(v: Views) -> DataFrame:
    """Orders as files of cross-reference text: a header, a topic, references, a reciprocal section; some books are unknown."""
    text = lambda c: F.col(c).cast("string")
    order, line = F.col("l_orderkey"), F.col("line_no")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = v.table("lineitem").withColumn("line_no", F.row_number().over(place))
    code = lambda c, lost: F.when(F.col(c) % 5 == 0, F.lit(lost)).otherwise(F.concat(F.lit("Bk"), (F.col(c) % 4).cast("string")))
    last = (F.col("l_quantity").cast("int") + (F.col("l_suppkey") % 2).cast("int")).cast("string")
    ref = F.concat(code("l_partkey", "Zz"), F.lit("_"), text("line_no"), F.lit(":"), F.col("l_quantity").cast("int").cast("string"), F.lit("-"), last)
    items = lines.select(order.alias("file"), (line + F.when(line > 3, 10).otherwise(2)).alias("n"), F.when(line > 3, F.concat(ref, F.lit(" - note "), text("l_suppkey"))).otherwise(F.concat(ref, F.lit(" , "), ref)).alias("line"))
    files = v.table("lineitem").select("l_orderkey").distinct()
    head = F.concat(F.lit("{"), code("l_orderkey", "Zz"), F.lit(" "), text("l_orderkey"), F.lit(":1}"))
    topic = F.concat(F.lit('"topic '), (order % 7).cast("string"), F.lit('"'))
    heads = files.select(order.alias("file"), F.inline(F.array(*(F.struct(F.lit(n).alias("n"), line.alias("line")) for n, line in ((0, head), (1, topic), (10, F.lit("Reciprocal:")))))))
    edges = readers.reference_text(items.unionByName(heads), {f"Bk{i}": f"book{i}" for i in range(4)})
    return edges.drop("n")


@query("path_partition", r"select page_id, regexp_extract(p, '([^/]+)/[^/]*$', 1) as book, case when regexp_extract(p, '(\d+)[^/]*$', 1) = '' then 1 else regexp_extract(p, '(\d+)[^/]*$', 1)::int end as chapter from (select page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/$', '') as p from pages)")
def path_partition(v: Views) -> DataFrame:
    path = F.regexp_replace(F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "/$", "")
    return v.table("pages").withColumn("p", path).select("page_id", *readers.path_parts(F.col("p")))


@query("stateful_ffill", "select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as asked_at from conversations")
def stateful_ffill(v: Views) -> DataFrame:
    header = F.when(F.col("role") == "user", F.col("turn"))
    return readers.forward_fill(v.table("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", header, "asked_at")


@query("import_validate", "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events where event_id % 5 <> 0 and try_cast(json_extract_string(props, '$.k') as int) <= 60")
def import_validate(v: Views) -> DataFrame:
    """Backups from the event log: broken ones, unknown versions and foreign keys do not get in."""
    k = F.get_json_object("props", "$.k")
    version = F.when(k.cast("int") <= 60, "3").otherwise("4")
    text = F.concat(F.lit('{"version": '), version, F.lit(', "data": {"k": "'), k, F.lit('", "evil": "x"}}'))
    sent = v.table("events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(text).alias("body"))
    kept = readers.valid_backups(sent, "body", ["k"])
    return kept.select("event_id", F.element_at("data", "k").cast("int").alias("k"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("profile_tables", " union all ".join(f"select '{t}' as name, count(*) as n, (select count(*) from (describe {t}))::int as columns from {t}" for t in TABLES))
def profile_tables(v: Views) -> DataFrame:
    """Counts come from the files' footers."""
    each = []
    for name in TABLES:
        t = v.table(name)
        each.append(t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", F.lit(len(t.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, each)


#: The columns of all tables.
FIELDS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
_PLAIN = "typeof({c}) in ('VARCHAR', 'INTEGER', 'BIGINT')"
_KIND = "case typeof({c}) when 'VARCHAR' then 'text' when 'INTEGER' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'real' when 'TIMESTAMP' then 'time' else 'list' end"
_FIELD = f"select '{{t}}' as name, '{{c}}' as field, coalesce(max({_KIND}), '') as kind, count({{c}}) as filled, min(case when {_PLAIN} then {{c}}::varchar end) as least, max(case when {_PLAIN} then length({{c}}::varchar) end)::int as longest, count(distinct {{c}}) as different from {{t}}"


@query("profile_fields", " union all ".join(_FIELD.format(t=t, c=c) for t, fields in FIELDS.items() for c in fields.split()))
def profile_fields(v: Views) -> DataFrame:
    """For each field of every table its kind, how many values it has and how many different ones, and a sample and the greatest length of texts and whole numbers; two scans a table."""
    kinds = {"string": "text", "int": "integer", "bigint": "integer", "double": "real", "timestamp": "time", "timestamp_ntz": "time"}
    each = []
    for name, fields in FIELDS.items():
        table, kind = v.table(name), {f.name: kinds.get(f.dataType.simpleString(), "list") for f in v.table(name).schema}
        shown = lambda c: F.col(c).cast("string") if kind[c] in ("text", "integer") else F.lit(None).cast("string")  # noqa: B023, E731
        facts = [F.struct(F.count(c).alias("filled"), F.min(shown(c)).alias("least"), F.max(F.length(shown(c))).alias("longest")).alias(c) for c in fields.split()]
        rows = [F.struct(F.lit(name).alias("name"), F.lit(c).alias("field"), F.when(F.col(c)["filled"] > 0, kind[c]).otherwise("").alias("kind"), F.col(c)["filled"].alias("filled"), F.col(c)["least"].alias("least"), F.col(c)["longest"].alias("longest")) for c in fields.split()]
        # Values are told apart by two hashes, so that all fields are counted by one grouping of small rows.
        values = table.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(c), F.xxhash64(F.lit(1), c))).alias("value")) for c in fields.split()))))
        different = values.where("value is not null").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("different"))
        each.append(table.agg(*facts).select(F.inline(F.array(*rows))).join(different, "field", "left").select("name", "field", "kind", "filled", "least", "longest", F.coalesce("different", F.lit(0)).alias("different")))
    return reduce(DataFrame.unionByName, each)


@query("json_walk", "select event_id, '$.' || key as path, value from (select event_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events)")
def json_walk(v: Views) -> DataFrame:
    return nested.walk(v.table("events"), "event_id", "props").select(F.col("key").alias("event_id"), "path", "value")


def _deep(rows: DataFrame) -> DataFrame:
    """Documents as JSON five levels deep."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(F.struct(line.alias("text")).alias("at")))
    origin = F.struct("source", lines.alias("lines"))
    return rows.select("doc_id", F.to_json(F.struct("n_chars", F.struct("lang", origin.alias("origin")).alias("meta"))).alias("doc"))


PATHS = """
lines as (select doc_id, string_split(text, chr(10)) as l from documents),
paths as (
  select doc_id, '$.n_chars' as path, n_chars::varchar as value from documents where n_chars is not null
  union all select doc_id, '$.meta.lang', lang from documents where lang is not null
  union all select doc_id, '$.meta.origin.source', source from documents where source is not null
  union all select doc_id, '$.meta.origin.lines[' || (i - 1) || '].at.text', l[i] from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from lines))"""


@query("json_paths", f"with {PATHS} select * from paths")
def json_paths(v: Views) -> DataFrame:
    """Every value of documents of five levels, by its path."""
    return nested.walk(_deep(v.table("documents")), "doc_id", "doc").select(F.col("key").alias("doc_id"), "path", "value")


@query(
    "json_diff",
    f"""with {PATHS},
changed as (
  select doc_id, path, value as before, case when path = '$.meta.lang' then upper(value) when path like '%.text' then replace(value, ' the ', ' The ') else value end as after from paths)
select doc_id, path, before, after, (row_number() over (partition by doc_id order by path))::int as r, count(*) over (partition by doc_id) as changes
from changed where before <> after qualify r <= 10""",
)
def json_diff(v: Views) -> DataFrame:
    """What a correction changes in documents of five levels: the first ten paths of each, and how many."""
    docs = v.table("documents")
    fixed = docs.withColumn("lang", F.upper("lang")).withColumn("text", F.replace("text", F.lit(" the "), F.lit(" The ")))
    return nested.diff(_deep(docs), _deep(fixed), "doc_id", "doc").select(F.col("key").alias("doc_id"), "path", "before", "after", "r", "changes")


@query("json_map_blocks", "select doc_id::varchar as doc_id, lang, length(text) as n_chars, md5(text) as digest from documents")
def json_map_blocks(v: Views) -> DataFrame:
    """Documents written as JSON objects by id, and read again by blocks that begin anywhere."""
    path = new_path(v.spark, "maps")
    value = F.to_json(F.struct(F.struct("lang", "text").alias("inner"), F.array("source", "lang").alias("of")))
    jsonmaps.write_json_map(v.table("documents").select("doc_id", value.alias("value")), "doc_id", "value", path)
    got = jsonmaps.json_map(v.spark, path).select(F.col("key").alias("doc_id"), F.from_json("value", "inner struct<lang: string, text: string>").alias("value"))
    return got.select("doc_id", "value.inner.lang", F.length("value.inner.text").cast("bigint").alias("n_chars"), F.md5("value.inner.text").alias("digest"))


_WHOLE = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null)) = 0 and vec_id is not null and label is not null"


@query("npz_ranges", f"select vec_id as idx, label, len(embedding)::int as dim, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings where {_WHOLE}")
def npz_ranges(v: Views) -> DataFrame:
    """Vectors written as numpy archives, and read again by ranges of rows; archives have no nulls, so vectors without all their components are left out."""
    path = new_path(v.spark, "npz")
    whole = F.col("embedding").isNotNull() & (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull())
    npz.write_npz(v.table("embeddings").where(whole & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", "label", "embedding"), path)
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return npz.read_npz(v.spark, path).select(F.col("vec_id").alias("idx"), "label", F.size("embedding").alias("dim"), F.round(F.sqrt(square), 6).alias("norm"))


@query("url_parse", r"select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) as path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, nullif(regexp_extract(url, '#(.*)$', 1), '') as fragment from pages")
def url_parse(v: Views) -> DataFrame:
    url = F.col("url")
    return v.table("pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), F.parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"), F.parse_url(url, F.lit("REF")).alias("fragment"))
