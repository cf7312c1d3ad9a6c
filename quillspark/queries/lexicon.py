"""Queries: the frequency lexicon, its scopes, letters and pages, and word studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lexicon as op
from ..plans.adapters import Views
from ..plans.roster import Roster
from .search import WORD, forms_sql

roster = Roster()
query = roster.query

STATS = """
stats as (
  select word, sum(cnt)::bigint as total, coalesce(sum(cnt) filter (where translation = 'old'), 0)::bigint as old,
    coalesce(sum(cnt) filter (where translation = 'new'), 0)::bigint as new, count(distinct book_slug) as books from words group by word)"""


@query("lexicon", f"with {STATS} select * from stats")
def lexicon(v: Views) -> DataFrame:
    return v.lexicon()


@query(
    "lex_scopes",
    """select scope, word, sum(cnt)::bigint as total from (
  select word, cnt, unnest([case when testament = 'old' then 'old' end, case when testament = 'new' then 'new' end,
    case when not noncanonical then 'canonical' end, case when noncanonical then 'noncanonical' end, 'book:' || book_slug]) as scope from words)
where scope is not null group by all""",
)
def lex_scopes(v: Views) -> DataFrame:
    return op.scopes(v.words())


@query(
    "lex_scope_stats",
    """select s.scope, coalesce(count(distinct word), 0) as unique_words, coalesce(sum(cnt), 0)::bigint as total_words from (select unnest(['old', 'new', 'canonical', 'noncanonical', 'nowhere']) as scope) s
left join (select word, cnt, unnest([testament, case when noncanonical then 'noncanonical' else 'canonical' end]) as scope from words) w on s.scope = w.scope group by 1""",
)
def lex_scope_stats(v: Views) -> DataFrame:
    """An unknown scope has zeros, whereas its word list falls back to all words."""
    asked = v.spark.createDataFrame([(s,) for s in ("old", "new", "canonical", "noncanonical", "nowhere")], "scope string")
    found = op.scopes(v.words(), with_books=False).groupBy("scope").agg(F.count(F.lit(1)).alias("u"), F.sum("total").alias("t"))
    return asked.join(found, "scope", "left").select("scope", F.coalesce("u", F.lit(0)).alias("unique_words"), F.coalesce("t", F.lit(0)).alias("total_words"))


@query("lex_letters", f"with {STATS} select lower(substr(word, 1, 1)) as letter, count(*) as total_words, sum(total)::bigint as total_occurrences, coalesce(nullif(instr('abcdefghijklmnopqrstuvwxyz', lower(substr(word, 1, 1))), 0), 999)::int as ord from stats group by all")
def lex_letters(v: Views) -> DataFrame:
    return op.letters(v.lexicon())


@query("lex_meta", f"with {STATS} select count(*) as unique_words, sum(total)::bigint as total_words, count(distinct lower(substr(word, 1, 1))) as letters, count(*) filter (where old > 0) as unique_old, count(*) filter (where new > 0) as unique_new from stats")
def lex_meta(v: Views) -> DataFrame:
    s = v.lexicon()
    return s.agg(F.count(F.lit(1)).alias("unique_words"), F.sum("total").alias("total_words"), F.countDistinct(F.lower(F.substring("word", 1, 1))).alias("letters"), F.count_if(F.col("old") > 0).alias("unique_old"), F.count_if(F.col("new") > 0).alias("unique_new"))


@query("book_stats", "select w.book_slug, v.verses, count(distinct word) as unique_words, sum(cnt)::bigint as total_words from words w join (select book_slug, count(*) as verses from verses group by 1) v using (book_slug) group by all")
def book_stats(v: Views) -> DataFrame:
    verses = v.verses().groupBy("book_slug").agg(F.count(F.lit(1)).alias("verses"))
    words = v.words().groupBy("book_slug").agg(F.countDistinct("word").alias("unique_words"), F.sum("cnt").alias("total_words"))
    return verses.join(words, "book_slug").select("book_slug", "verses", "unique_words", "total_words")


@query("lex_trans_scope", f"with {STATS} select word, old as total, books from stats where old > 0 order by total desc, word limit 500")
def lex_trans_scope(v: Views) -> DataFrame:
    return v.lexicon().where("old > 0").select("word", F.col("old").alias("total"), "books").orderBy(F.desc("total"), "word").limit(500)


@query(
    "lex_page",
    f"""with {STATS}, letter as (select * from stats where lower(substr(word, 1, 1)) = 't'),
page as (select *, (select ceil(count(*) / 50)::bigint from letter) as total_pages from letter order by total desc, word limit 50 offset 50)
select p.*, coalesce(g.n, 1) as forms_count, coalesce(f.lemma, p.word) as lemma from page p left join word_forms f on f.form = p.word left join (select lemma, count(*) as n from word_forms group by 1) g on g.lemma = f.lemma""",
)
def lex_page(v: Views) -> DataFrame:
    """Second page of a letter; only the page's rows meet the word groups."""
    letter = v.lexicon("t")
    pages = letter.agg(F.ceil(F.count(F.lit(1)) / 50).alias("total_pages"))
    page = letter.orderBy(F.desc("total"), "word").offset(50).limit(tx.clamp_limit(50, "letter")).crossJoin(F.broadcast(pages))
    forms = v.word_forms()
    found = page.join(forms, F.col("word") == F.col("form"), "left")
    groups = forms.join(found.select("lemma").distinct(), "lemma", "left_semi").groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))
    return found.join(groups, "lemma", "left").select("word", "total", "old", "new", "books", "total_pages", F.coalesce("n", F.lit(1)).alias("forms_count"), F.coalesce("lemma", "word").alias("lemma"))


@query("lex_search", f"with {STATS} select * from (select word, total from stats where contains(lower(word), 'ion') order by lower(substr(word, 1, 1)), total desc, word limit 100) order by total desc, word")
def lex_search(v: Views) -> DataFrame:
    """The first hits in letter order, sorted by frequency afterwards: not the overall top."""
    return v.words_with("ion").orderBy(F.lower(F.substring("word", 1, 1)), F.desc("total"), "word").limit(tx.clamp_limit(100, "words")).orderBy(F.desc("total"), "word")


NEEDLES = ("io", "ion", "TION", "thing", "ention", "chement", "orantion", "zzz")


@query("lex_grams", f"with {STATS} select needle, word, total from stats, (select unnest({list(NEEDLES)}) as needle) where contains(lower(word), lower(needle))")
def lex_grams(v: Views) -> DataFrame:
    """All words that hold one of the needles of two to eight letters; each reads the shortest of its lists, or all share one count of the words."""
    return v.words_with_each(NEEDLES)


PER_FORM = f"""
{forms_sql(WORD)},
per_form as (
  select o.token, count(*) as total, count(*) filter (where translation = 'old') as old, count(*) filter (where translation = 'new') as new, count(distinct book_slug) as books
  from occurrences o join qforms f on o.token = f.form group by 1)"""


def _of_word(v: Views) -> DataFrame:
    """Postings of the word's forms, with their books."""
    return v.postings_of(v.forms_of([WORD])).join(v.verses().select("idx", "book_slug"), "idx")


@query("word_stats", f"with {PER_FORM} select min_by(token, (left(token, 1), -total, token)) as word, sum(total)::bigint as total, sum(old)::bigint as old, sum(new)::bigint as new, max(books) as books from per_form")
def word_stats(v: Views) -> DataFrame:
    """Sums over forms, but the largest number of books of any one form."""
    each = _of_word(v).groupBy("token").agg(
        F.sum("cnt").alias("total"),
        F.sum(F.when(F.col("translation") == "old", F.col("cnt")).otherwise(0)).alias("old"),
        F.sum(F.when(F.col("translation") == "new", F.col("cnt")).otherwise(0)).alias("new"),
        F.countDistinct("book_slug").alias("books"),
    )
    order = F.struct(F.substring("token", 1, 1), -F.col("total"), F.col("token"))
    return each.agg(F.min_by("token", order).alias("word"), F.sum("total").alias("total"), F.sum("old").alias("old"), F.sum("new").alias("new"), F.max("books").alias("books"))


@query("word_distribution", f"with {forms_sql(WORD)} select book_slug, count(*) as total from occurrences o join qforms f on o.token = f.form group by 1")
def word_distribution(v: Views) -> DataFrame:
    return _of_word(v).groupBy("book_slug").agg(F.sum("cnt").alias("total"))


@query("word_verses", f"with {forms_sql(WORD)} select book_slug, chapter, verse from (select distinct v.book_slug, v.chapter, v.verse from postings p join qforms f on p.token = f.form join verses v using (idx)) order by book_slug, chapter, verse limit 50 offset 20")
def word_verses(v: Views) -> DataFrame:
    """Keys in alphabetical, not canonical, order of books."""
    found = _of_word(v).select("idx").distinct().join(v.verses().select("idx", "book_slug", "chapter", "verse"), "idx")
    return found.select("book_slug", "chapter", "verse").distinct().orderBy("book_slug", "chapter", "verse").offset(20).limit(tx.clamp_limit(50, "verses"))


@query(
    "verse_words",
    """with df as (select token, count(distinct idx) as df from postings group by 1),
grouped as (select lemma, sum(df)::bigint as total, count(*) as forms_count from word_forms join df on form = token group by 1)
select token as word, first_pos, g.total, g.forms_count, lemma from (
  select token, min(pos) as first_pos from (select unnest(list) as token, unnest(range(len(list))) as pos from (select regexp_extract_all(lower(new), '\\p{L}+') as list from verses where idx = 7)) group by 1)
join word_forms on form = token join grouped g using (lemma) order by total, first_pos""".replace("\\\\", "\\"),
)
def verse_words(v: Views) -> DataFrame:
    """Rarest words first; a group's frequency is the sum of its forms' document frequencies."""
    df = v.stored("tokens").select("token", "df") if v.index else v.doc_freq()
    forms = v.word_forms()
    grouped = forms.join(df, F.col("form") == F.col("token")).groupBy("lemma").agg(F.sum("df").alias("total"), F.count(F.lit(1)).alias("forms_count"))
    words = v.verses().where("idx = 7").select(F.posexplode(tx.tokens(F.col("new"))).alias("pos", "word")).groupBy("word").agg(F.min("pos").cast("bigint").alias("first_pos"))
    return words.join(forms, F.col("word") == F.col("form")).join(grouped, "lemma").select("word", "first_pos", "total", "forms_count", "lemma").orderBy("total", "first_pos")


@query("word_locations", "select token, translation, count(*) as n, list_sort(list(distinct idx)) as locations from occurrences where token in ('thing', 'nicht', 'orantion') group by all")
def word_locations(v: Views) -> DataFrame:
    found = v.postings_of(v.spark.createDataFrame([(w,) for w in ("thing", "nicht", "orantion")], "form string"))
    return found.groupBy("token", "translation").agg(F.sum("cnt").alias("n"), F.array_sort(F.collect_set("idx")).alias("locations"))


PAIRS = """with ws as (select token, count(*) as n from occurrences where length(token) >= 6 group by 1 having count(*) >= 5),
ranked as (select token, left(token, 5) as stem, row_number() over (partition by left(token, 5) order by token) as r from ws)
select a, b, p as prefix from (select x.token as a, y.token as b, list_max(list_filter(range(5, least(length(x.token), length(y.token)) + 1), lambda k: left(x.token, k) = left(y.token, k))) as p
  from ranked x join ranked y on x.stem = y.stem and y.r - x.r between 1 and 49 where abs(length(x.token) - length(y.token)) <= 4)
where p / ((length(a) + length(b)) / 2.0::double) >= 0.82::double"""


@query(
    "prefix_pairs",
    PAIRS,
)
def prefix_pairs(v: Views) -> DataFrame:
    return op.prefix_pairs(op.frequent_words(v.occurrences(), 6, 5))


@query(
    "prefix_groups",
    f"""with recursive pairs as ({PAIRS}),
links as (select a, b from pairs union all select b, a from pairs),
frequent as (select token from occurrences where length(token) >= 6 group by 1 having count(*) >= 5),
reached(form, other) as (select token, token from frequent union select r.form, l.b from reached r join links l on l.a = r.other)
select form, min_by(other, (length(other), other)) as lemma from reached group by form""",
)
def prefix_groups(v: Views) -> DataFrame:
    """Components of the prefix pairs."""
    words = op.frequent_words(v.occurrences(), 6, 5)
    return op.prefix_groups(words, op.prefix_pairs(words))


