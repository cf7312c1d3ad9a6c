"""Queries: topics over verse ranges, and cross-references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bags
from ..operators import topics as op
from ..operators.alike import alike
from ..plans.adapters import Views
from ..plans.roster import Roster
from ..plans.segments import SENT

roster = Roster()
query = roster.query


@query("topic_search", "select slug, name_en, verse_count, count(*) over () as total from topics where contains(lower(name_en), '1') or contains(slug, '1') or contains(lower(source), '1') order by verse_count desc, slug limit 10")
def topic_search(v: Views) -> DataFrame:
    q = F.lit("1")
    hits = v.topics().where(F.contains(F.lower("name_en"), q) | F.contains("slug", q) | F.contains(F.lower("source"), q))
    return hits.orderBy(F.desc("verse_count"), "slug").limit(tx.clamp_limit(10, "topics")).crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total")))).select("slug", "name_en", "verse_count", "total")


@query("topic_top10", "select slug, verse_count from topics order by verse_count desc, slug limit 10")
def topic_top10(v: Views) -> DataFrame:
    return v.topics().orderBy(F.desc("verse_count"), "slug").limit(10).select("slug", "verse_count")


LABEL = "case when vs = ve then chapter || ':' || vs else chapter || ':' || vs || '-' || ve end"


@query("ref_format", f"select distinct chapter, vs, ve, {LABEL} as label from topic_refs")
def ref_format(v: Views) -> DataFrame:
    return v.topic_refs().select("chapter", "vs", "ve").distinct().withColumn("label", tx.range_label(F.col("chapter"), F.col("vs"), F.col("ve")))


@query("range_expand", "select topic_slug, book, chapter, unnest(range(vs, ve + 1))::int as verse, pos from topic_refs")
def range_expand(v: Views) -> DataFrame:
    return v.topic_refs().select("topic_slug", "book", "chapter", F.explode(F.sequence("vs", "ve")).alias("verse"), "pos")


@query("range_join", "select r.book, r.chapter, v.verse, count(*) as covers from topic_refs r join (select distinct book, chapter, vs as verse from topic_refs) v on r.book = v.book and r.chapter = v.chapter and v.verse between r.vs and r.ve group by all")
def range_join(v: Views) -> DataFrame:
    """Containment as an equi-join on the expanded verses: no theta join, and the ranges are short."""
    verses = v.topic_refs().select("book", "chapter", F.col("vs").alias("verse")).distinct()
    return range_expand(v).groupBy("book", "chapter", "verse").agg(F.count(F.lit(1)).alias("covers")).join(verses, ["book", "chapter", "verse"])


@query("topic_build", "select slug, name_en, source, verse_count, labels, refs from topics join (select topic_slug as slug, count(distinct label) as labels, list_sort(list(distinct book || ' ' || chapter))[1:5] as refs from topic_refs group by 1) using (slug)")
def topic_build(v: Views) -> DataFrame:
    """Each topic's first five chapters are ranked before they are gathered."""
    refs = v.topic_refs().select(F.col("topic_slug").alias("slug"), "label", F.concat_ws(" ", "book", F.col("chapter").cast("string")).alias("ref"))
    labels = refs.groupBy("slug").agg(F.countDistinct("label").alias("labels"))
    first = refs.select("slug", "ref").distinct().withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy("ref"))).where("r <= 5")
    shown = first.groupBy("slug").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    return v.topics().join(labels, "slug").join(shown, "slug").select("slug", "name_en", "source", "verse_count", "labels", "refs")


@query("topic_detail", "select label, count(*) as n_refs, list(book || ' ' || chapter || ':' || vs || coalesce(' ' || cap, '') order by pos, book, chapter, vs)[1:5] as verses from (select r.*, n.n_name as cap from topic_refs r left join nation n on n.n_nationkey = r.vs where topic_slug = 'brand-7') group by label")
def topic_detail(v: Views) -> DataFrame:
    """Entries of one topic with their first verses; a verse without text keeps its place."""
    refs = v.topic_refs().where("topic_slug = 'brand-7'").join(v.table("nation").select(F.col("n_nationkey").alias("vs_key"), "n_name"), F.col("vs") == F.col("vs_key"), "left")
    shown = F.concat(F.col("book"), F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("vs").cast("string"), F.coalesce(F.concat(F.lit(" "), "n_name"), F.lit("")))
    counts = refs.groupBy("label").agg(F.count(F.lit(1)).alias("n_refs"))
    first = refs.withColumn("shown", shown).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("pos", "book", "chapter", "vs"))).where("r <= 5")
    verses = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "shown"))), lambda x: x["shown"]).alias("verses"))
    return counts.join(verses, "label").select("label", "n_refs", "verses")


@query("topic_digest", f"select topic_slug, label, {LABEL} as ref, book, r, greatest(n - 5, 0) as remaining from (select *, row_number() over (partition by topic_slug, label order by pos, book, chapter, vs, ve) as r, count(*) over (partition by topic_slug, label) as n from topic_refs where topic_slug in ('brand-1', 'brand-2')) where r <= 5")
def topic_digest(v: Views) -> DataFrame:
    refs = v.topic_refs().where("topic_slug in ('brand-1', 'brand-2')")
    group = Window.partitionBy("topic_slug", "label")
    ranked = refs.withColumn("r", F.row_number().over(group.orderBy("pos", "book", "chapter", "vs", "ve"))).withColumn("n", F.count(F.lit(1)).over(group)).where("r <= 5")
    return ranked.select("topic_slug", "label", tx.range_label(F.col("chapter"), F.col("vs"), F.col("ve")).alias("ref"), "book", F.col("r").cast("bigint").alias("r"), F.greatest(F.col("n") - 5, F.lit(0)).alias("remaining"))


@query("see_also", "select s.slug, t.slug as see_slug, t.verse_count from (select slug, unnest(['brand-' || (verse_count % 30)::varchar, replace(lower(source), 'o', '-')]) as see from topics) s join topics t on t.slug = s.see")
def see_also(v: Views) -> DataFrame:
    """Links to topics that do not exist are dropped."""
    topics = v.topics()
    links = topics.select("slug", F.explode(F.array(F.concat(F.lit("brand-"), (F.col("verse_count") % 30).cast("string")), F.replace(F.lower("source"), F.lit("o"), F.lit("-")))).alias("see"))
    return links.join(topics.select(F.col("slug").alias("see_slug"), "verse_count"), F.col("see") == F.col("see_slug")).select("slug", "see_slug", "verse_count")


@query("topics_of_verse", "select slug, verse_count from verse_topics join topics on topic_slug = slug where book = 'b3' and chapter = 2 and verse = 10 order by verse_count desc, slug")
def topics_of_verse(v: Views) -> DataFrame:
    here = v.verse_topics().where("book = 'b3' and chapter = 2 and verse = 10")
    return here.join(v.topics(), F.col("topic_slug") == F.col("slug")).select("slug", "verse_count").orderBy(F.desc("verse_count"), "slug")


@query("topic_span_count", "select topic_slug, sum(ve - vs + 1)::bigint as verse_count from topic_refs group by 1")
def topic_span_count(v: Views) -> DataFrame:
    return v.topic_refs().groupBy("topic_slug").agg(F.sum(F.col("ve") - F.col("vs") + 1).alias("verse_count"))


BOOK_TOPICS = "book_topics as (select *, row_number() over (partition by book order by n desc, topic_slug) as r from (select book, topic_slug, count(*) as n from topic_refs group by all))"


@query("book_topics", f"with {BOOK_TOPICS} select b.book, topic_count, verse_count, topic_slug, n, r from book_topics join (select book, count(distinct topic_slug) as topic_count, count(*) as verse_count from topic_refs group by 1) b using (book) where r <= 20")
def book_topics(v: Views) -> DataFrame:
    totals = v.topic_refs().groupBy("book").agg(F.countDistinct("topic_slug").alias("topic_count"), F.count(F.lit(1)).alias("verse_count"))
    return op.top_topics(v.topic_refs(), 20).join(totals, "book").select("book", "topic_count", "verse_count", "topic_slug", "n", "r")


@query("testament_topics", f"with {BOOK_TOPICS} select case when book < 'b5' then 'old' else 'new' end as testament, topic_slug, sum(n)::bigint as n from book_topics where r <= 20 group by all")
def testament_topics(v: Views) -> DataFrame:
    """Sums over the books' top lists, hence below the true totals."""
    testament = F.when(F.col("book") < "b5", "old").otherwise("new").alias("testament")
    return op.top_topics(v.topic_refs(), 20).groupBy(testament, "topic_slug").agg(F.sum("n").alias("n"))


@query("topic_samples", "select topic_slug, book, chapter, verse, r from (select *, row_number() over (partition by topic_slug order by book, chapter, verse) as r from verse_topics) where r <= 5")
def topic_samples(v: Views) -> DataFrame:
    w = Window.partitionBy("topic_slug").orderBy("book", "chapter", "verse")
    return v.verse_topics().withColumn("r", F.row_number().over(w).cast("bigint")).where("r <= 5").select("topic_slug", "book", "chapter", "verse", "r")


@query(
    "topic_lift",
    """with baskets as (select distinct l_orderkey as verse, p_type || '/' || (l_linenumber % 3)::varchar as topic from lineitem join part on l_partkey = p_partkey),
word as (select o_orderkey as verse from orders where o_orderpriority = '1-URGENT'),
sizes as (select (select count(distinct verse) from baskets) as n, (select count(*) from word where verse in (select verse from baskets)) as w),
totals as (select topic, count(*) as t from baskets group by 1),
hits as (select topic, count(*) as c from baskets where verse in (select verse from word) group by 1)
select topic, c, t, round(c / (w * t / n::double), 2) as lift, round(w / n::double, 6) as coverage, w / n::double > 0.3::double as common from hits join totals using (topic), sizes where c >= 2 order by lift desc, c desc, topic limit 20""",
)
def topic_lift(v: Views) -> DataFrame:
    topic = F.concat("p_type", F.lit("/"), (F.col("l_linenumber") % 3).cast("string"))
    baskets = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("verse"), topic.alias("topic")).distinct()
    word = v.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("verse"))
    return op.lift(baskets, word)


@query("range_clip", "select r.topic_slug, r.book, r.chapter, r.vs, least(r.ve, m.top) as ve from topic_refs r join (select book, chapter, max(vs) - 2 as top from topic_refs group by all) m using (book, chapter) where r.vs <= m.top")
def range_clip(v: Views) -> DataFrame:
    tops = v.topic_refs().groupBy("book", "chapter").agg((F.max("vs") - 2).alias("top"))
    return op.clip(v.topic_refs().select("topic_slug", "book", "chapter", "vs", "ve"), tops)


@query("match_rate", "select count(*) as refs, round(avg(case when k.verse is not null then 1.0::double else 0 end), 6) as rate from topic_refs r left join (select distinct book, chapter, vs as verse from topic_refs where pos % 2 = 0) k on r.book = k.book and r.chapter = k.chapter and r.ve = k.verse")
def match_rate(v: Views) -> DataFrame:
    known = v.topic_refs().where("pos % 2 = 0").select("book", "chapter", F.col("vs").alias("ve"), F.lit(1.0).alias("hit")).distinct()
    return v.topic_refs().select("book", "chapter", "ve").join(known, ["book", "chapter", "ve"], "left").agg(F.count(F.lit(1)).alias("refs"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("rate"))


VERSIFIED = """
refs as (select distinct case pos % 4 when 0 then 'malachi' when 1 then 'nehemiah' else 'psalms' end as book, (case when pos % 4 < 2 then 3 + pos % 3 else pos % 152 + 1 end)::int as chapter, vs, ve from topic_refs),
numbered as (
  select book, chapter as from_chapter, vs as from_vs, ve as from_ve, part, case when book <> 'psalms' then case when book = 'malachi' and chapter = 4 then 3 else chapter end when part = 1 then case
      when chapter between 1 and 9 or chapter > 147 then chapter when chapter = 10 then 9 when chapter between 11 and 113 then chapter - 1 when chapter = 114 then 113
      when chapter = 115 then 113 when chapter = 116 then case when vs <= 9 then 114 else 115 end when chapter between 117 and 146 then chapter - 1
      when chapter = 147 then case when vs <= 11 then 146 else 147 end end
    else chapter - 1 + case when chapter = 147 then 1 else 0 end end as chapter, case when book = 'psalms' then chapter else -1 end as c,
    case when book = 'malachi' and chapter = 4 then 18 when book = 'nehemiah' and chapter = 4 and (vs >= 18 or part = 2) then 15 else 0 end as ahead, vs, ve
  from refs, (select unnest([1, 2]) as part)
  where part = 1 or (book = 'psalms' and ((chapter = 116 and vs <= 9 and ve > 9) or (chapter = 147 and vs <= 11 and ve > 11))) or (book = 'nehemiah' and chapter = 4 and vs < 18 and ve >= 18))
select book, from_chapter, from_vs, from_ve, chapter::int as chapter,
  (case when part = 2 and book = 'nehemiah' then 33 when part = 2 then 1 when c = 10 then vs + 21 when c = 115 then vs + 8 when c = 116 and vs > 9 then vs - 9 when c = 147 and vs > 11 then vs - 11 else vs + ahead end)::int as vs,
  (case when book = 'nehemiah' and from_chapter = 4 and part = 1 and vs < 18 then least(ve, 17) when part = 2 and book = 'psalms' then ve - case c when 116 then 9 else 11 end when c = 10 then ve + 21 when c = 115 then ve + 8
    when c = 116 then case when vs > 9 then ve - 9 else least(ve, 9) end when c = 147 then case when vs > 11 then ve - 11 else least(ve, 11) end else ve + ahead end)::int as ve
from numbered"""


@query("versification", "with " + VERSIFIED.strip())
def versification(v: Views) -> DataFrame:
    pos = F.col("pos")
    book = F.when(pos % 4 == 0, "malachi").when(pos % 4 == 1, "nehemiah").otherwise("psalms")
    chapter = F.when(pos % 4 < 2, 3 + pos % 3).otherwise(pos % 152 + 1).cast("int")
    refs = v.topic_refs().select(book.alias("book"), chapter.alias("chapter"), "vs", "ve").distinct()
    return op.renumber(refs, F.col("book"))


@query("topic_append", "select slug, verse_count, 'main' as part from topics union all select 'added-' || book, sum(ve - vs + 1)::bigint, 'added' from topic_refs where book in ('b1', 'b2') group by book")
def topic_append(v: Views) -> DataFrame:
    added = v.topic_refs().where("book in ('b1', 'b2')").groupBy("book").agg(F.sum(F.col("ve") - F.col("vs") + 1).alias("verse_count"))
    added = added.select(F.concat(F.lit("added-"), "book").alias("slug"), "verse_count", F.lit("added").alias("part"))
    return v.topics().select("slug", "verse_count", F.lit("main").alias("part")).unionByName(added)


ERRATA = "(values ('b1', 1, 5, [51, 52]), ('b2', 2, 7, [71]), ('b3', 3, 9, []::int[]))"


@query("errata_apply", f"select r.topic_slug, r.book, r.chapter, r.vs, r.pos from topic_refs r left join {ERRATA} e(book, chapter, vs, put) using (book, chapter, vs) where e.book is null union all select r.topic_slug, r.book, r.chapter, unnest(put), r.pos from topic_refs r join {ERRATA} e(book, chapter, vs, put) using (book, chapter, vs)")
def errata_apply(v: Views) -> DataFrame:
    """Wrong references give way to their replacements, of which there may be none."""
    errata = v.spark.createDataFrame([("b1", 1, 5, [51, 52]), ("b2", 2, 7, [71]), ("b3", 3, 9, [])], "book string, chapter int, vs int, put array<int>")
    joined = v.topic_refs().select("topic_slug", "book", "chapter", "vs", "pos").join(F.broadcast(errata), ["book", "chapter", "vs"], "left")
    return joined.select("topic_slug", "book", "chapter", F.explode(F.coalesce("put", F.array("vs"))).alias("vs"), "pos")


@query("map_and_anti", "select 'unmapped' as kind, n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey where n_nationkey >= 20 group by 2 union all select 'mapped', 'all', count(*) from customer where c_nationkey < 20")
def map_and_anti(v: Views) -> DataFrame:
    """Customers of nations that have a code, and counts of those that have none."""
    codes = v.table("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"))
    rows = v.table("customer").select("c_nationkey")
    skipped = rows.join(F.broadcast(codes), "c_nationkey", "left_anti").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.join(F.broadcast(codes), "c_nationkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return skipped.select(F.lit("unmapped").alias("kind"), F.col("n_name").alias("name"), "n").unionByName(kept.select(F.lit("mapped").alias("kind"), F.lit("all").alias("name"), "n"))


@query("code_discovery", "select distinct unnest(string_split(replace(p_brand, '#', '-'), '-')) as code from part")
def code_discovery(v: Views) -> DataFrame:
    return v.table("part").select(F.explode(F.split(F.replace("p_brand", F.lit("#"), F.lit("-")), "[-.]")).alias("code")).distinct()


@query("sitemap_rows", "select '/' || book_slug || '/' || chapter as url, case when chapter = 1 then 0.8::double else 0.6::double end as priority from (select distinct book_slug, chapter from verses) union all select '/topic/' || slug, case when verse_count >= 2500 then 0.7::double when verse_count >= 2400 then 0.5::double else 0.3::double end from topics")
def sitemap_rows(v: Views) -> DataFrame:
    chapters = v.verses().select("book_slug", "chapter").distinct().select(F.concat(F.lit("/"), "book_slug", F.lit("/"), F.col("chapter").cast("string")).alias("url"), F.when(F.col("chapter") == 1, 0.8).otherwise(0.6).alias("priority"))
    topics = v.topics().select(F.concat(F.lit("/topic/"), "slug").alias("url"), F.when(F.col("verse_count") >= 2500, 0.7).when(F.col("verse_count") >= 2400, 0.5).otherwise(0.3).alias("priority"))
    return chapters.unionByName(topics)


# -- cross-references -------------------------------------------------------------------


@query("xref_build", "select src, book, chapter, vs, ve, votes, r from (select *, row_number() over (partition by src order by votes desc, dst) as r from xrefs)")
def xref_build(v: Views) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("votes"), "dst")
    return v.xrefs().withColumn("r", F.row_number().over(w).cast("bigint")).select("src", "book", "chapter", "vs", "ve", "votes", "r")


@query("xref_filter", "select src, dst, confidence, votes from xrefs where coalesce(confidence, 0) >= 55 and votes >= 3 order by votes desc, src, dst limit 50")
def xref_filter(v: Views) -> DataFrame:
    return op.confident(v.xrefs(), 55, 3).orderBy(F.desc("votes"), "src", "dst").limit(tx.clamp_limit(200, "references")).select("src", "dst", "confidence", "votes")


@query(
    "xref_enrich",
    """select x.dst, x.book, coalesce(v.book, x.book) as name, x.chapter, x.vs, x.ve, x.votes, x.confidence, x.topic, x.type, case when length(t) > 200 then substr(t, 1, 200) || '...' else t end as preview, (select count(*) from xrefs where src = 42) as total
from xrefs x left join (select idx, book, coalesce(nullif(new, ''), old, '') as t from verses) v on v.idx = x.dst where src = 42 and confidence >= 45""",
)
def xref_enrich(v: Views) -> DataFrame:
    """References with the first 200 characters of their verse, of the new text or else the old one; ``total`` counts before the filter."""
    mine = v.xrefs().where("src = 42").select("dst", F.col("book").alias("code"), "chapter", "vs", "ve", "votes", "confidence", "topic", "type")
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    texts = v.verses().select(F.col("idx").alias("dst"), F.col("book").alias("name"), tx.preview(F.col("new"), F.col("old")).alias("preview"))
    shown = op.confident(mine, 45, 0).join(texts, "dst", "left").crossJoin(F.broadcast(total))
    return shown.select("dst", F.col("code").alias("book"), F.coalesce("name", "code").alias("name"), "chapter", "vs", "ve", "votes", "confidence", "topic", "type", "preview", "total")


@query("xref_dedupe", "select src, book, chapter, topic, min(dst) as first_dst, count(*) as n from xrefs group by all")
def xref_dedupe(v: Views) -> DataFrame:
    """The first of several edges with one key stays; order is explicit."""
    return v.xrefs().groupBy("src", "book", "chapter", "topic").agg(F.min("dst").alias("first_dst"), F.count(F.lit(1)).alias("n"))


@query("xref_stats", "select * from (select 'type' as kind, type as name, count(*) as n from xrefs group by 2 union all select * from (select 'topic', topic, count(*) as n from xrefs group by 2 order by n desc, topic limit 10))")
def xref_stats(v: Views) -> DataFrame:
    x = v.xrefs()
    types = x.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    topics = x.groupBy(F.col("topic").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(10)
    return types.withColumn("kind", F.lit("type")).unionByName(topics.withColumn("kind", F.lit("topic"))).select("kind", "name", "n")


@query("votes_summary", "select min(l_quantity) as least, max(l_quantity) as most, round(avg(l_quantity), 6) as mean, list_sort(list(l_quantity))[(count(*) // 2 + 1)] as upper_median from lineitem")
def votes_summary(v: Views) -> DataFrame:
    """Upper median by counts of distinct values: nothing but a histogram is gathered."""
    return op.summary(v.table("lineitem"), "l_quantity")


@query("osis_parse", r"select ref, book, chapter, vs, case when last_book = book and last_chapter = chapter then last_verse else vs end as ve from (select ref, nullif(regexp_extract(ref, '^([A-Z][a-z]+)\.(\d+)\.(\d+)', 1), '') as book, try_cast(regexp_extract(ref, '^([A-Z][a-z]+)\.(\d+)\.(\d+)', 2) as int) as chapter, try_cast(regexp_extract(ref, '^([A-Z][a-z]+)\.(\d+)\.(\d+)', 3) as int) as vs, regexp_extract(ref, '-([A-Z][a-z]+)\.(\d+)\.(\d+)$', 1) as last_book, try_cast(regexp_extract(ref, '-([A-Z][a-z]+)\.(\d+)\.(\d+)$', 2) as int) as last_chapter, try_cast(regexp_extract(ref, '-([A-Z][a-z]+)\.(\d+)\.(\d+)$', 3) as int) as last_verse from (select distinct case l_orderkey % 4 when 0 then 'Bad ref' when 1 then 'Gen.' || l_linenumber || '.' || l_quantity::int when 2 then 'Gen.' || l_linenumber || '.' || l_quantity::int || '-Gen.' || l_linenumber || '.' || (l_quantity::int + 3) else 'Exod.' || l_linenumber || '.' || l_quantity::int || '-Exod.' || (l_linenumber + 1) || '.2' end as ref from lineitem))")
def osis_parse(v: Views) -> DataFrame:
    c, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int")
    start = F.concat(F.lit("Gen."), c, F.lit("."), q.cast("string"))
    exod = F.concat(F.lit("Exod."), c, F.lit("."), q.cast("string"), F.lit("-Exod."), (F.col("l_linenumber") + 1).cast("string"), F.lit(".2"))
    turn = F.col("l_orderkey") % 4
    ref = F.when(turn == 0, "Bad ref").when(turn == 1, start).when(turn == 2, F.concat(start, F.lit("-Gen."), c, F.lit("."), (q + 3).cast("string"))).otherwise(exod)
    return op.parse_osis(v.table("lineitem").select(ref.alias("ref")).distinct(), "ref")


@query("ref_parse", r"select ref, trim(regexp_extract(ref, '([IVX]+\s+)?([a-z]+)\s+(\d+):(\d+)(?:[-,](\d+))?', 1)) as prefix, regexp_extract(ref, '([IVX]+\s+)?([a-z]+)\s+(\d+):(\d+)(?:[-,](\d+))?', 2) as abbr, try_cast(regexp_extract(ref, '([IVX]+\s+)?([a-z]+)\s+(\d+):(\d+)(?:[-,](\d+))?', 3) as int) as chapter, try_cast(regexp_extract(ref, '([IVX]+\s+)?([a-z]+)\s+(\d+):(\d+)(?:[-,](\d+))?', 4) as int) as verse, try_cast(nullif(regexp_extract(ref, '([IVX]+\s+)?([a-z]+)\s+(\d+):(\d+)(?:[-,](\d+))?', 5), '') as int) as verse_end from (select distinct case l_orderkey % 3 when 0 then 'see II kings ' when 1 then 'gen ' else 'IV esd ' end || l_linenumber || ':' || l_quantity::int || case when l_suppkey % 2 = 0 then '-' || (l_quantity::int + 2) else '' end as ref from lineitem)")
def ref_parse(v: Views) -> DataFrame:
    turn = F.col("l_orderkey") % 3
    q = F.col("l_quantity").cast("int")
    head = F.when(turn == 0, "see II kings ").when(turn == 1, "gen ").otherwise("IV esd ")
    tail = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("-"), (q + 2).cast("string"))).otherwise("")
    refs = v.table("lineitem").select(F.concat(head, F.col("l_linenumber").cast("string"), F.lit(":"), q.cast("string"), tail).alias("ref")).distinct()
    return op.parse_refs(refs, "ref")


@query("topic_name_mode", "select topic, token, n from (select *, row_number() over (partition by topic order by n desc, token) as r from (select source as topic, token, count(*) as n from (select d.source, unnest(regexp_extract_all(lower(d.text), '[a-z]+')) as token from (select *, row_number() over (partition by source order by doc_id) as k from documents) d where k <= 100) where left(token, 3) = 'the' and token not in ('the', 'them', 'then') group by all)) where r = 1")
def topic_name_mode(v: Views) -> DataFrame:
    """The most common word with a given root among a topic's first hundred verses."""
    first = v.table("documents").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("k <= 100")
    words = first.select(F.col("source").alias("topic"), F.explode(tx.tokens(F.col("text"), tx.SEARCH_CLASS)).alias("token"))
    words = words.where((F.substring("token", 1, 3) == "the") & ~F.col("token").isin("the", "them", "then"))
    best = words.groupBy("topic", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("topic").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("token").alias("token"))).alias("best"))
    return best.select("topic", "best.token", (-F.col("best.m")).alias("n"))


@query(
    "vec_pairs",
    r"""with placed as (select distinct token, idx from postings where length(token) >= 5 and idx in (select vec_id from embeddings)),
forms as (select token, length(token) as n from placed group by 1),
near as (select a.token as a, b.token as b from forms a join forms b on left(a.token, 5) = left(b.token, 5) and a.token < b.token
  where left(a.token, ceil(0.7::double * least(a.n, b.n))::int) = left(b.token, ceil(0.7::double * least(a.n, b.n))::int)),
pooled as (select token, i, avg(x) as m from (select p.token, unnest(e.embedding::double[]) as x, unnest(range(len(e.embedding))) as i from placed p join embeddings e on e.vec_id = p.idx
  where p.token in (select a from near union select b from near)) group by all),
vectors as (select token, list(m order by i) as v, sqrt(sum(m * m)) as norm from pooled group by 1)
select a, b, round(list_dot_product(x.v, y.v) / (x.norm * y.norm), 6) as cosine from near join vectors x on x.token = a join vectors y on y.token = b where list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9::double""",
)
def vec_pairs(v: Views) -> DataFrame:
    """Words alike in form and meaning: five letters in common, seven tenths of the shorter word, and a cosine of 0.9.

    A word's vector is the mean over its verses.  Verses without a vector are not looked at; words of one
    stem meet with their vectors, once.
    """
    vectors = v.table("embeddings").select(F.col("vec_id").alias("idx"), "embedding").where("embedding is not null")
    if not v.index and v.distinct_ids():
        ends = vectors.agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("idx").alias("n")).first()
        texts = v.verses().where(F.col("idx").between(ends.a, ends.b))
        if ends.n <= SENT and ends.n < (ends.b or 0) - (ends.a or 0) >> 1:  # else most texts between have one
            texts = texts.join(F.broadcast(vectors.select("idx")), "idx", "left_semi")
        rows = bags.told_apart(texts.join(vectors, "idx"), 5, f"embedding {vectors.schema['embedding'].dataType.simpleString()}")
    else:
        placed = v.postings().where("length(token) >= 5").join(vectors.select("idx"), "idx", "left_semi")
        rows = placed.groupBy("idx").agg(F.collect_set("token").alias("tokens")).join(vectors, "idx")
    return alike(rows, least_prefix=5, least_share=0.7, least_cosine=0.9).select("a", "b", F.round("cosine", 6).alias("cosine"))
