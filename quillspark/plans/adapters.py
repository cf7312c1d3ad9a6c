"""Logical relations over the given tables, as DataFrames (``Views``) and as DuckDB SQL (``CTES``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import Stored, known
from .shared import written

#: So many keys at most are handed to the scan of a stored table as a list; more are joined, between the least and the greatest.
LISTED = 1000


class Views:
    """The relations of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, index: Stored | None | str = ""):
        """``index``: the stored index; the one in use, unless it is given."""
        self.spark, self.dir = spark, sf_dir
        self.index = known(spark, sf_dir) if index == "" else index
        self._held: dict = {}

    def _once(self, key, make):
        """What several parts of a query ask for, made once for all of them."""
        if key not in self._held:
            self._held[key] = make()
        return self._held[key]

    def stored(self, name: str) -> DataFrame:
        return self.index.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def verses(self) -> DataFrame:
        """Documents as verses: the first half of a text is its new translation, the rest its old one."""
        half = (F.col("n_chars") / 2).cast("int")
        slug = F.concat_ws("-", "lang", "source")
        return self.table("documents").select(
            F.col("doc_id").alias("idx"),
            slug.alias("book_slug"),
            F.concat(F.lit("Book "), slug).alias("book"),
            F.when(F.col("lang") == "en", "new").otherwise("old").alias("testament"),
            (F.col("lang") == "es").alias("noncanonical"),
            (F.floor(F.col("doc_id") / 20) % 10 + 1).cast("int").alias("chapter"),
            F.col("doc_id").cast("int").alias("verse"),
            F.substring("text", F.lit(1), half).alias("new"),
            F.substring("text", half + 1, F.length("text")).alias("old"),
        )

    def books(self) -> DataFrame:
        """The book dimension with its order; windows run over one row per book."""
        from pyspark.sql import Window

        each = self.verses().groupBy("book_slug").agg(
            F.min_by("book", "idx").alias("book"), F.min("testament").alias("testament"), F.bool_or("noncanonical").alias("noncanonical")
        )
        return each.withColumn("ord", F.row_number().over(Window.orderBy("book_slug")))

    def sides(self) -> DataFrame:
        """Rows (idx, book_slug, testament, noncanonical, chapter, verse, translation, text)."""
        both = F.inline(F.array(F.struct(F.lit("new").alias("translation"), F.col("new").alias("text")), F.struct(F.lit("old").alias("translation"), F.col("old").alias("text"))))
        return self.verses().select("idx", "book_slug", "testament", "noncanonical", "chapter", "verse", both)

    def occurrences(self) -> DataFrame:
        """Rows (idx, book_slug, translation, token), one per word of a text."""
        return self.sides().select("idx", "book_slug", "testament", "noncanonical", "translation", F.explode(tx.tokens(F.col("text"))).alias("token"))

    def distinct_ids(self) -> bool:
        """Has every document an id of its own?  Then what a text holds is known in its row; else rows with one id are one text and have to meet."""

        def look() -> bool:
            ids = self.table("documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
            return ids.where("rows > 1 or doc_id is null").isEmpty()

        return self._once("distinct_ids", look)

    def token_sums(self) -> DataFrame:
        """Rows (token, df, dl) of documents with ids of their own: in how many a token is; the dl add up to the number of all words."""
        from ..operators import bags

        return self._once("token_sums", lambda: written(bags.sums(self.verses())))

    def hits(self, forms: DataFrame) -> DataFrame:
        """Rows (token, idx, translation, cnt, dl) of the tokens in column ``form`` in documents with ids of their own, from one look at the texts; dl is the document's length."""
        from ..operators import bags

        def make() -> DataFrame:
            few = [r.form for r in forms.select("form").distinct().limit(LISTED + 1).collect()]
            if len(few) <= LISTED:
                return written(bags.counted(self.verses(), few))
            return written(bags.counted(self.verses()).join(F.broadcast(forms.select(F.col("form").alias("token")).distinct()), "token", "left_semi"))

        return self._once(("hits", id(forms)), make)

    def doc_freq(self) -> DataFrame:
        """Rows (token, df): in how many documents a token is."""
        if self.index or not self.distinct_ids():
            return self.postings().select("token", "idx").distinct().groupBy("token").agg(F.count("idx").alias("df"))
        from ..operators import bags

        return bags.sums(self.verses()).select("token", "df")

    def postings(self) -> DataFrame:
        if self.index:
            return self.stored("postings")
        if self.distinct_ids():
            from ..operators import bags

            return bags.counted(self.verses()).drop("dl")
        return self.occurrences().groupBy("token", "idx", "translation").agg(F.count(F.lit(1)).alias("cnt"))

    def tokens_by_text(self) -> DataFrame:
        """Rows (idx, token, tf, new): how often a token is in a document, and how often in its new translation."""
        if self.distinct_ids():
            from ..operators import bags

            return bags.by_text(self.verses())
        return self.occurrences().groupBy("idx", "token").agg(F.count(F.lit(1)).alias("tf"), F.count_if(F.col("translation") == "new").alias("new"))

    def postings_of(self, forms: DataFrame) -> DataFrame:
        """The postings of some tokens (column ``form``): looked up, or counted after all others have gone."""
        if self.index:
            few = [r.form for r in forms.select("form").distinct().limit(LISTED + 1).collect()]
            if len(few) <= LISTED:
                return self.stored("postings").where(F.col("token").isin(few))
            ends = forms.agg(F.min("form").alias("a"), F.max("form").alias("b")).first()
            near = self.stored("postings").where(F.col("token").between(ends.a, ends.b))
            return near.join(forms.select(F.col("form").alias("token")).distinct(), "token", "left_semi")
        if self.distinct_ids():
            return self.hits(forms).select("token", "idx", "translation", "cnt")
        hits = self.occurrences().join(forms.select(F.col("form").alias("token")).distinct(), "token", "left_semi")
        return hits.groupBy("token", "idx", "translation").agg(F.count(F.lit(1)).alias("cnt"))

    def positions(self) -> DataFrame:
        """Where every word stands: (token, idx, translation, steps, gaps)."""
        from ..operators import phrase

        return self.stored("positions") if self.index else phrase.positions(self.sides().select("idx", "translation", "text"))

    def word_forms(self) -> DataFrame:
        """form -> lemma: the shortest, then first, word with the same five letters; shorter words stand for themselves."""
        if self.index:
            return self.stored("word_forms")
        return self.forms_from(self.occurrences().select(F.col("token").alias("form")).distinct())

    def forms_from(self, forms: DataFrame) -> DataFrame:
        """``word_forms`` from rows (form)."""
        stem = F.substring("form", 1, 5)
        lemmas = forms.where(F.length("form") >= 5).groupBy(stem.alias("stem")).agg(F.min(F.struct(F.length("form").alias("n"), F.col("form").alias("form")))["form"].alias("lemma"))
        return forms.join(lemmas, stem == F.col("stem"), "left").select("form", F.coalesce("lemma", "form").alias("lemma"))

    def forms_of(self, words: list[str]) -> DataFrame:
        """Rows (pos, word, form): the forms of some words; a group of forms shares its first letters, so they are few."""
        from ..operators import search

        if not self.index:
            return self._once(("forms", *words), lambda: self._forms_in_texts(words))
        if hasattr(self.index, "forms_near"):
            return search.expand_forms(self.spark, words, self.index.forms_near(words))
        lemma = {r.form: r.lemma for r in self.stored("word_forms").where(F.col("form").isin(words)).collect()}
        forms = self.stored("lemma_forms").where(F.col("lemma").isin(list(set(lemma.values())))).select("form", "lemma")
        return search.expand_forms(self.spark, words, forms)

    def _forms_in_texts(self, words: list[str]) -> DataFrame:
        """``forms_of`` without an index: only tokens that may share a lemma with one of the words are told apart."""
        from ..operators import search

        found = self._held["token_sums"] if "token_sums" in self._held else self.occurrences()
        near = [F.startswith("token", F.lit(w[:5])) if len(w) >= 5 else F.col("token") == w for w in words]
        forms = search.expand_forms(self.spark, words, self.forms_from(found.where(reduce(Column.__or__, near)).select(F.col("token").alias("form")).distinct()))
        few = forms.limit(LISTED + 1).collect()
        return self.spark.createDataFrame([tuple(r) for r in few], forms.schema) if len(few) <= LISTED else written(forms)

    def words(self) -> DataFrame:
        """The lexicon's fact table: (word, book_slug, testament, noncanonical, translation, cnt), case kept."""
        if self.index:
            return self.stored("words")
        word = F.explode(tx.tokens(tx.fold_script(F.col("text")), tx.LEXICON_CLASS, lower=False)).alias("word")
        each = self.sides().select("book_slug", "testament", "noncanonical", "translation", word)
        return each.groupBy("word", "book_slug", "testament", "noncanonical", "translation").agg(F.count(F.lit(1)).alias("cnt"))

    def words_by_text(self) -> DataFrame:
        """``words`` of each text (column idx)."""
        if self.distinct_ids():
            from ..operators import bags

            return bags.cased(self.verses().withColumns({c: tx.fold_script(F.col(c)) for c in ("new", "old")}), "book_slug string, testament string, noncanonical boolean")
        word = F.explode(tx.tokens(tx.fold_script(F.col("text")), tx.LEXICON_CLASS, lower=False)).alias("word")
        each = self.sides().select("idx", "book_slug", "testament", "noncanonical", "translation", word)
        return each.groupBy("idx", "word", "book_slug", "testament", "noncanonical", "translation").agg(F.count(F.lit(1)).alias("cnt"))

    def lexicon(self, letter: str | None = None) -> DataFrame:
        """(word, total, old, new, books), of the words that begin with a letter (in any case) only, if one is given."""
        from ..operators import lexicon

        if self.index:
            stored = self.stored("lexicon")
            return (stored if letter is None else stored.where(F.col("letter") == letter)).drop("letter")
        words = self.words()
        return lexicon.word_stats(words if letter is None else words.where(F.lower(F.substring("word", 1, 1)) == letter))

    def words_with(self, needle: str) -> DataFrame:
        """(word, total) of the lexicon's words that hold ``needle``; an index of segments has no lists of letters, as totals change with every commit."""
        from ..operators import grams

        if isinstance(self.index, Stored):
            return grams.holding(needle, self.lexicon(), self.stored("grams"), self.stored("gram_counts"))
        return grams.holding(needle, self.lexicon() if self.index else self.word_totals())

    def words_with_each(self, needles: tuple[str, ...]) -> DataFrame:
        """Rows (needle, word, total) of ``words_with`` for several needles; without an index all are looked for in one count of the words."""
        from ..operators import grams

        if self.index:
            return reduce(DataFrame.unionByName, [self.words_with(n).select(F.lit(n).alias("needle"), "word", "total") for n in needles])
        return grams.holding_each(needles, self.word_totals())

    def word_totals(self) -> DataFrame:
        """(word, total) of the lexicon, counted from the texts."""
        word = F.explode(tx.tokens(tx.fold_script(F.col("text")), tx.LEXICON_CLASS, lower=False)).alias("word")
        return self.sides().select(word).groupBy("word").agg(F.count(F.lit(1)).alias("total"))

    def topic_refs(self) -> DataFrame:
        """Line items as references of topics (part brands) to verse ranges."""
        first = F.col("l_quantity").cast("int")
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("topic_slug"),
                F.col("p_brand").alias("name_en"),
                F.col("p_type").alias("source"),
                F.col("l_returnflag").alias("label"),
                F.concat(F.lit("b"), (F.col("l_suppkey") % 10).cast("string")).alias("book"),
                F.col("l_linenumber").cast("int").alias("chapter"),
                first.alias("vs"),
                (first + (F.col("l_orderkey") % 4).cast("int")).alias("ve"),
                F.col("l_orderkey").alias("pos"),
            )
        )

    def topics(self) -> DataFrame:
        """A topic's verse_count is its number of references, not of verses."""
        return self.topic_refs().groupBy(F.col("topic_slug").alias("slug")).agg(F.min("name_en").alias("name_en"), F.min("source").alias("source"), F.count(F.lit(1)).alias("verse_count"))

    def verse_topics(self) -> DataFrame:
        """Distinct (topic_slug, book, chapter, verse) of the expanded ranges."""
        return self.topic_refs().select("topic_slug", "book", "chapter", F.explode(F.sequence("vs", "ve")).alias("verse")).distinct()

    def xrefs(self) -> DataFrame:
        """Cross-references between vectors at most eight ids apart, weighted by cosine and label."""
        v = self.table("embeddings")
        dot = F.aggregate(F.zip_with("embedding", "to_embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
        there = v.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("to_embedding"), F.col("label").alias("to_label"))
        near = v.withColumn("dst", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.col("vec_id") + d)))
        same = F.col("label") == F.col("to_label")
        return near.join(there, "dst").select(
            F.col("vec_id").alias("src"),
            "dst",
            F.concat(F.lit("b"), (F.col("dst") % 10).cast("string")).alias("book"),
            (F.floor(F.col("dst") / 10) % 10 + 1).cast("int").alias("chapter"),
            (F.col("dst") % 30 + 1).cast("int").alias("vs"),
            (F.col("dst") % 30 + 1 + F.col("dst") % 3).cast("int").alias("ve"),
            F.round(50 + 50 * dot).cast("int").alias("confidence"),
            (F.when(same, 10).otherwise(0) + (F.col("vec_id") + F.col("dst")) % 7).cast("int").alias("votes"),
            F.concat(F.lit("t"), (F.col("to_label") % 5).cast("string")).alias("topic"),
            F.when(same, "thematic").otherwise("reciprocal").alias("type"),
        )

    def marks(self) -> DataFrame:
        """Events as what users did with verses: bookmarks, colours, tags, notes."""
        k = F.get_json_object("props", "$.k").cast("int")
        colours = F.array(*(F.lit(c) for c in ("yellow", "green", "blue", "pink", "mud")))
        return self.table("events").select(
            "event_id",
            "user_id",
            "ts",
            F.col("event_type").alias("action"),
            k.alias("k"),
            F.concat(F.lit("b"), (k % 10).cast("string")).alias("book"),
            (k % 7 + 1).cast("int").alias("chapter"),
            F.element_at(colours, (k % 5 + 1).cast("int")).alias("colour"),
            (F.col("event_type") == "purchase").alias("pinned"),
            F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("note "), k.cast("string"))).alias("comment"),
            F.array(F.concat(F.lit("t"), (k % 4).cast("string")), F.concat(F.lit("t"), (k % 6).cast("string"))).alias("tags"),
        )


CTES: dict[str, str] = {
    "verses": r"""
  select doc_id as idx, lang || '-' || source as book_slug, 'Book ' || lang || '-' || source as book,
    case when lang = 'en' then 'new' else 'old' end as testament, lang = 'es' as noncanonical,
    ((doc_id // 20) % 10 + 1)::int as chapter, doc_id::int as verse,
    substr(text, 1, (n_chars // 2)::int) as new, substr(text, (n_chars // 2)::int + 1) as old
  from documents""",
    "books": r"""
  select *, (row_number() over (order by book_slug))::int as ord
  from (select book_slug, min_by(book, idx) as book, min(testament) as testament, bool_or(noncanonical) as noncanonical from verses group by book_slug)""",
    "sides": r"""
  select idx, book_slug, testament, noncanonical, chapter, verse, 'new' as translation, new as text from verses
  union all select idx, book_slug, testament, noncanonical, chapter, verse, 'old', old from verses""",
    "occurrences": r"""
  select idx, book_slug, testament, noncanonical, translation, unnest(regexp_extract_all(lower(text), '\p{L}+')) as token from sides""",
    "postings": r"""
  select token, idx, translation, count(*) as cnt from occurrences group by all""",
    "word_forms": r"""
  select f.form, coalesce(l.lemma, f.form) as lemma from (select distinct token as form from occurrences) f
  left join (select left(token, 5) as stem, min_by(token, (length(token), token)) as lemma
    from (select distinct token from occurrences) where length(token) >= 5 group by 1) l
  on left(f.form, 5) = l.stem and length(f.form) >= 5""",
    "words": r"""
  select word, book_slug, testament, noncanonical, translation, count(*) as cnt
  from (select book_slug, testament, noncanonical, translation, unnest(regexp_extract_all(text, '\p{L}+')) as word from sides) group by all""",
    "topic_refs": r"""
  select lower(replace(p_brand, '#', '-')) as topic_slug, p_brand as name_en, p_type as source, l_returnflag as label,
    'b' || (l_suppkey % 10)::varchar as book, l_linenumber::int as chapter, l_quantity::int as vs,
    (l_quantity::int + l_orderkey % 4)::int as ve, l_orderkey as pos
  from lineitem join part on l_partkey = p_partkey""",
    "topics": r"""
  select topic_slug as slug, min(name_en) as name_en, min(source) as source, count(*) as verse_count from topic_refs group by 1""",
    "verse_topics": r"""
  select distinct topic_slug, book, chapter, verse from (select topic_slug, book, chapter, unnest(range(vs, ve + 1))::int as verse from topic_refs)""",
    "xrefs": r"""
  select a.vec_id as src, b.vec_id as dst, 'b' || (b.vec_id % 10)::varchar as book, ((b.vec_id // 10) % 10 + 1)::int as chapter,
    (b.vec_id % 30 + 1)::int as vs, (b.vec_id % 30 + 1 + b.vec_id % 3)::int as ve,
    round(50 + 50 * list_dot_product(a.embedding::double[], b.embedding::double[]))::int as confidence,
    ((case when a.label = b.label then 10 else 0 end) + (a.vec_id + b.vec_id) % 7)::int as votes,
    't' || (b.label % 5)::varchar as topic, case when a.label = b.label then 'thematic' else 'reciprocal' end as type
  from embeddings a join embeddings b on b.vec_id - a.vec_id between 1 and 8""",
    "marks": r"""
  select event_id, user_id, ts, event_type as action, k, 'b' || (k % 10)::varchar as book, (k % 7 + 1)::int as chapter,
    list_extract(['yellow', 'green', 'blue', 'pink', 'mud'], k % 5 + 1) as colour, event_type = 'purchase' as pinned,
    case when k % 3 = 0 then '' else 'note ' || k::varchar end as comment, ['t' || (k % 4)::varchar, 't' || (k % 6)::varchar] as tags
  from (select *, json_extract_string(props, '$.k')::int as k from events)""",
}
