"""Queries: audits, typos, rewriting, lookups, differences and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import containment, patterns
from ..operators import quality as op
from ..plans.adapters import Views
from ..plans.roster import Roster

roster = Roster()
query = roster.query


#: The agents, and names that the given pages have.
AGENTS = (*op.CRAWLERS, "spam-farm", "cheap-pills")


@query("ua_filter", f"select page_id, url from pages where regexp_matches(lower(url), '{'|'.join(AGENTS)}')")
def ua_filter(v: Views) -> DataFrame:
    return v.table("pages").where(op.contains_any(F.col("url"), AGENTS)).select("page_id", "url")


@query("dim_override", "select n_nationkey, coalesce(put, n_name) as name, put is not null and put <> n_name as changed from nation left join (values (3, 'THIRD'), (7, 'NATION_7')) o(k, put) on n_nationkey = k")
def dim_override(v: Views) -> DataFrame:
    names = v.spark.createDataFrame([(3, "THIRD"), (7, "NATION_7")], "k int, put string")
    joined = v.table("nation").join(F.broadcast(names), F.col("n_nationkey") == F.col("k"), "left")
    return joined.select("n_nationkey", F.coalesce("put", "n_name").alias("name"), (F.col("put").isNotNull() & (F.col("put") != F.col("n_name"))).alias("changed"))


TRIAGE = [(r"[#*$%&]{3,}", "symbols"), (r"[A-Z]{4,}!!", "shouting"), (r"\| ", "table"), (r"[0-9]{3,}", "digits"), (r"\(c\)|License", "license")]


@query("label_triage", "select doc_id, reason from (select doc_id, case " + " ".join(f"when regexp_matches(text, '{p}') then '{r}'" for p, r in TRIAGE) + " end as reason from documents) where reason is not null")
def label_triage(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", op.first_reason(F.col("text"), TRIAGE).alias("reason")).where("reason is not null")


SHARE = "(case when length(text) > 0 then length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text)::double else 0 end)"
MIXED = f"case when {SHARE} > 0.8::double then 'full' when {SHARE} > 0.3::double then 'heavy' when {SHARE} > 0.05::double then 'light' else 'none' end"


@query("audit_mixed_script", rf"select doc_id, round({SHARE}, 6) as share, {MIXED} as class from documents where not regexp_matches(text, '^[A-Z]{{2,3}}\.\d+\.\d+$') and not source like '%9'")
def audit_mixed_script(v: Views) -> DataFrame:
    """Values that only look wrong, and fields that are foreign by design, are left out."""
    docs = v.table("documents").where(~F.col("text").rlike(r"^[A-Z]{2,3}\.\d+\.\d+$") & ~F.endswith("source", F.lit("9")))
    return docs.select("doc_id", F.round(op.latin_share(F.col("text")), 6).alias("share"), op.mixed_class(F.col("text")).alias("class"))


PROBLEMS = {"latin": "[A-Za-z]{3,}", "double_space": "  ", "digits": "[0-9]+", "tight_mark": r"[a-z][.,;:!?][a-z]", "symbols": "[#*$%&]"}


@query("fmt_errors", "select doc_id, kind, n from (select doc_id, unnest([" + ", ".join(f"{{'kind': '{k}', 'n': len(regexp_extract_all(text, '{p}'))}}" for k, p in PROBLEMS.items()) + "], recursive := true) from documents) where n > 0")
def fmt_errors(v: Views) -> DataFrame:
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("bigint").alias("n")) for k, p in PROBLEMS.items()))
    return v.table("documents").select("doc_id", F.inline(counts)).where("n > 0")


@query("audit_report", "select kind, source, count(*) as documents, sum(n)::bigint as n from (select doc_id, source, unnest([" + ", ".join(f"{{'kind': '{k}', 'n': len(regexp_extract_all(text, '{p}'))}}" for k, p in PROBLEMS.items()) + "], recursive := true) from documents) where n > 0 group by all")
def audit_report(v: Views) -> DataFrame:
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("bigint").alias("n")) for k, p in PROBLEMS.items()))
    return v.table("documents").select("source", F.inline(counts)).where("n > 0").groupBy("kind", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))


@query("ocr_patterns", "select doc_id, len(regexp_extract_all(text, '" + "|".join(c * 3 + "+" for c in "abcdefghijklmnopqrstuvwxyz") + "')) as repeats, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3 and suffix(x, 'wh'))) as endings from documents")
def ocr_patterns(v: Views) -> DataFrame:
    """Letters three times in a row, by a back-reference, and words with an unlikely end."""
    endings = F.filter(tx.tokens(F.col("text"), "[a-z]+"), lambda w: (F.length(w) >= 3) & F.endswith(w, F.lit("wh")))
    return v.table("documents").select("doc_id", F.regexp_count("text", F.lit(r"([a-z])\1{2,}")).cast("bigint").alias("repeats"), F.size(endings).cast("bigint").alias("endings"))


@query(
    "typo_suspects",
    """with counts as (select token as word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) where length(token) >= 5 group by 1),
pairs as (select a.word, a.n as count, b.word as fix, b.n as fix_count from
  (select *, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1))))) as key from counts where n <= 1) a
  join (select *, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1))))) as key from counts where n >= 40) b using (key) where levenshtein(a.word, b.word) = 1)
select word, count, fix, fix_count from (select *, row_number() over (partition by word order by fix_count desc, fix) as r from (select distinct * from pairs)) where r = 1""",
)
def typo_suspects(v: Views) -> DataFrame:
    words = v.table("documents").select(F.explode(tx.tokens(F.col("text"), "[a-z]+")).alias("word"))
    return op.typo_suspects(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), 1, 40, 5)


#: The twin counts bytes, so it gives each character a byte of its own first.
BYTE_ITEMS = """with wide as (select coalesce(string_agg(c, '' order by c), '') as chars from (select distinct unnest(string_split(text, '')) as c from benchmark) where c > chr(127)),
spare as (select string_agg(chr(i::int), '' order by i) as codes from range(1, 128) r(i) where i < 9 or i between 14 and 31 or i = 127),
items as (select item_id, left(text, 2) as block, translate(text, chars, left(codes, length(chars)::int)) as t from benchmark, wide, spare)"""


@query("edit_distance", f"{BYTE_ITEMS} select a.item_id as a, b.item_id as b, levenshtein(a.t, b.t)::int as distance from items a join items b on b.item_id = a.item_id + 1")
def edit_distance(v: Views) -> DataFrame:
    """Each item's whole text against the next one's, character by character."""
    items = v.table("benchmark")
    a = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.col("text").alias("x"))
    return a.join(items.select(F.col("item_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", F.levenshtein("x", "y").alias("distance"))


@query("edit_distance_block", f"{BYTE_ITEMS} select a.item_id as a, b.item_id as b, levenshtein(a.t, b.t)::int as distance from items a join items b on a.block = b.block and a.item_id < b.item_id")
def edit_distance_block(v: Views) -> DataFrame:
    """All pairs of items that begin alike (a blocking key)."""
    items = v.table("benchmark").select(F.col("item_id").alias("id"), "text", F.substring("text", 1, 2).alias("block"))
    a, b = (items.select("block", F.col("id").alias(n), F.col("text").alias(f"text_{n}")) for n in ("a", "b"))
    return a.join(b, "block").where("a < b").select("a", "b", F.levenshtein("text_a", "text_b").alias("distance"))


@query("lookup_cascade", "select p_partkey, coalesce(a.put, b.put, c.put, upper(left(p_name, 1)) || substr(p_name, 2)) as name, case when a.put is not null then 'root' when b.put is not null then 'topic' when c.put is not null then 'name' else 'case' end as from_level from part left join (values ('small ring', 'RING')) a(k, put) on p_name = a.k left join (select p_brand as k, min(p_name) as put from part where p_brand in ('Brand#1', 'Brand#2') group by 1) b on p_brand = b.k left join (select 'LARGE' as k, r_name as put from region where r_regionkey = 2) c on p_type = c.k")
def lookup_cascade(v: Views) -> DataFrame:
    part = v.table("part")
    root = v.spark.createDataFrame([("small ring", "RING")], "k1 string, put1 string")
    topic = part.where(F.col("p_brand").isin("Brand#1", "Brand#2")).groupBy(F.col("p_brand").alias("k2")).agg(F.min("p_name").alias("put2"))
    name = v.table("region").where("r_regionkey = 2").select(F.lit("LARGE").alias("k3"), F.col("r_name").alias("put3"))
    joined = part.join(F.broadcast(root), F.col("p_name") == F.col("k1"), "left").join(topic, F.col("p_brand") == F.col("k2"), "left").join(name, F.col("p_type") == F.col("k3"), "left")
    title = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", F.lit(2), F.length("p_name")))
    level = F.when(F.col("put1").isNotNull(), "root").when(F.col("put2").isNotNull(), "topic").when(F.col("put3").isNotNull(), "name").otherwise("case")
    return joined.select("p_partkey", F.coalesce("put1", "put2", "put3", title).alias("name"), level.alias("from_level"))


@query("label_lookup", "select label, case when label in ('general', 'reciprocal') then '' when regexp_matches(t, '[A-Za-z]{3,}') then '' else t end as shown from (select label, coalesce(put, regexp_replace(label, '[A-Z]+_', '№', 'g')) as t from (select n_name as label from nation union all select r_name from region union all select 'general') left join (values ('ASIA', '亚'), ('NATION_3', 'three')) m(k, put) on label = k)")
def label_lookup(v: Views) -> DataFrame:
    """A map first, else rules; what still shows three Latin letters is not shown at all."""
    known = v.spark.createDataFrame([("ASIA", "亚"), ("NATION_3", "three")], "k string, put string")
    labels = v.table("nation").select(F.col("n_name").alias("label")).unionByName(v.table("region").select(F.col("r_name").alias("label"))).unionByName(v.spark.createDataFrame([("general",)], "label string"))
    shown = labels.join(F.broadcast(known), F.col("label") == F.col("k"), "left").withColumn("t", F.coalesce("put", F.regexp_replace("label", "[A-Z]+_", "№")))
    return shown.select("label", F.when(F.col("label").isin("general", "reciprocal") | F.col("t").rlike("[A-Za-z]{3,}"), "").otherwise(F.col("t")).alias("shown"))


@query(
    "context_audit",
    r"""with terms as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) as word from benchmark),
hits as (select item_id, doc_id, min(word) as word, count(*) as n_words from terms join (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents) on token = word group by all)
select item_id, doc_id, word, n_words, row_number() over (partition by item_id order by doc_id) as r from hits qualify r <= 3""",
)
def context_audit(v: Views) -> DataFrame:
    """The first three verses that show any long word of a label, and how many of them: an equi-join on tokens instead of a regex join."""
    labels = v.table("benchmark").select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text"), "[a-z]{7,}"))).alias("word"))
    words = v.table("documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text"), "[a-z]+"))).alias("token"))
    hits = words.join(labels.distinct(), F.col("token") == F.col("word")).groupBy("item_id", "doc_id").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("n_words"))
    w = Window.partitionBy("item_id").orderBy("doc_id")
    return hits.withColumn("r", F.row_number().over(w).cast("bigint")).where("r <= 3").select("item_id", "doc_id", "word", "n_words", "r")


@query("fuzzy_prefix", "select item_id, doc_id, priority from (select *, row_number() over (partition by item_id order by priority, doc_id) as r from (select item_id, doc_id, 0 as priority from benchmark b join documents d on b.text = d.text union all select item_id, doc_id, 1 from benchmark b join documents d on left(b.text, 50) = left(d.text, 50) union all select item_id, doc_id, 2 from benchmark b join (select doc_id, text, unnest(string_split(text, chr(10))) as line from documents) d on left(b.text, 40) = left(d.line, 40))) where r = 1")
def fuzzy_prefix(v: Views) -> DataFrame:
    """Equal, else equal in the first 50 characters, else a line that begins alike; the best and first hit only."""
    items = v.table("benchmark").select("item_id", "text")
    docs = v.table("documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    exact = items.join(docs, "text").select("item_id", "doc_id", F.lit(0).alias("priority"))
    near = items.withColumn("k", F.substring("text", 1, 50)).drop("text").join(docs.withColumn("k", F.substring("text", 1, 50)).drop("text"), "k").select("item_id", "doc_id", F.lit(1).alias("priority"))
    inside = items.withColumn("k", F.substring("text", 1, 40)).join(lines.withColumn("k", F.substring("line", 1, 40)), "k").select("item_id", "doc_id", F.lit(2).alias("priority"))
    best = exact.unionByName(near).unionByName(inside).groupBy("item_id").agg(F.min(F.struct("priority", "doc_id")).alias("best"))
    return best.select("item_id", "best.doc_id", "best.priority")


RUNS_OF = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
PAIRS_OF = r"list_transform(list_filter(range(1, len(l) - 1), lambda i: l[i + 1] = ' '), lambda i: l[i] || ' ' || l[i + 2])"


@query(
    "context_patterns",
    rf"""with items as (select item_id, {RUNS_OF} as l from benchmark),
terms as (select distinct item_id, unnest(list_concat(list_filter(l, lambda w: length(w) >= 7 and regexp_matches(w, '^[\p{{L}}\p{{N}}_]')), {PAIRS_OF})) as term from items),
shown as (select doc_id, unnest(list_concat(list_filter(l, lambda w: regexp_matches(w, '^[\p{{L}}\p{{N}}_]')), {PAIRS_OF})) as term from (select doc_id, {RUNS_OF} as l from documents)),
hits as (select item_id, doc_id, count(*) as n_terms, sum(n)::bigint as n_hits, min(term) as first_term from terms join (select doc_id, term, count(*) as n from shown group by all) using (term) group by all)
select *, row_number() over (partition by item_id order by doc_id) as r from hits qualify r <= 3""",
)
def context_patterns(v: Views) -> DataFrame:
    """The first three texts that show any long word or any two neighbouring words of a label: one automaton over all of them."""
    found = patterns.first_contexts(v.table("documents"), "doc_id", "text", v.table("benchmark"), "item_id", patterns.words_and_pairs(F.col("text"), 7))
    return found.select(F.col("item").alias("item_id"), F.col("key").alias("doc_id"), "n_terms", "n_hits", "first_term", "r")


def _head(text: str, size: int) -> Column:
    return F.substring(text, 1, size)


def _mutual(v: Views) -> tuple[DataFrame, DataFrame]:
    """(item_id, doc_id, copies): texts that hold an item's first 40 characters; and by equal heads, that have their own 40 in an item."""
    items = v.table("benchmark").select("item_id", "text", _head("text", 40).alias("string"))
    docs = v.table("documents").select("doc_id", "text", _head("text", 40).alias("string"))
    holding = containment.holders(items, "string", docs, "doc_id", "text").join(items.select("item_id", "string"), "string")
    heads = docs.where("string <> ''").groupBy("string").agg(F.countDistinct("doc_id").alias("copies"), F.min("doc_id").alias("doc_id"))
    held = containment.holders(heads, "string", items, "item_id", "text").withColumnRenamed("key", "item_id").join(heads, "string")
    return holding.select("item_id", F.col("key").alias("doc_id")), held.select("item_id", "doc_id", "copies")


MUTUAL = """with pairs as (select item_id, doc_id, left(i.text, 40) <> '' and contains(d.text, left(i.text, 40)) as holding, left(d.text, 40) <> '' and contains(i.text, left(d.text, 40)) as held,
  i.text <> '' and starts_with(d.text, left(i.text, 50)) as begins from benchmark i, documents d)"""


@query("containment", f"{MUTUAL} select item_id, count_if(holding)::bigint as n_holding, min(case when holding then doc_id end) as first_holding, count_if(held)::bigint as n_held, min(case when held then doc_id end) as first_held from pairs group by 1")
def containment_of_heads(v: Views) -> DataFrame:
    """How many texts hold an item's first 40 characters at any place, and how many have their own first 40 in the item's text."""
    holding, held = _mutual(v)
    there = holding.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_holding"), F.min("doc_id").alias("first_holding"))
    here = held.groupBy("item_id").agg(F.sum("copies").alias("n_held"), F.min("doc_id").alias("first_held"))
    counts = v.table("benchmark").select("item_id").distinct().join(there, "item_id", "left").join(here, "item_id", "left")
    return counts.select("item_id", F.coalesce("n_holding", F.lit(0)).alias("n_holding"), "first_holding", F.coalesce("n_held", F.lit(0)).alias("n_held"), "first_held")


@query("curated_match", f"{MUTUAL} select item_id, case when bool_or(begins) then 0 else 1 end as rule, coalesce(min(case when begins then doc_id end), min(doc_id)) as doc_id from pairs where begins or holding or held group by 1")
def curated_match(v: Views) -> DataFrame:
    """A curated item's text: the first that begins with its first 50 characters, else the first that holds its 40 or is held by it."""
    items = v.table("benchmark").select("item_id", _head("text", 50).alias("start")).where("start <> ''")
    lengths = sorted(r[0] for r in items.select(F.length("start")).distinct().collect())  # fifty at most
    starts = F.array_distinct(F.array(*(_head("text", n) for n in lengths))) if lengths else F.array().cast("array<string>")
    begins = v.table("documents").where("text is not null").select("doc_id", F.explode(starts).alias("start")).join(items, "start").select("item_id", "doc_id", F.lit(0).alias("rule"))
    holding, held = _mutual(v)
    other = holding.unionByName(held.drop("copies")).withColumn("rule", F.lit(1))
    best = begins.unionByName(other).groupBy("item_id").agg(F.min(F.struct("rule", "doc_id")).alias("best"))
    return best.select("item_id", "best.rule", "best.doc_id")


RENAMES = [("the ", "ze "), ("tion", "shun"), ("ing", "in"), ("ü", "ue")]


@query("change_topk", "select old, new, n from (" + " union all ".join(f"select '{a}' as old, '{b}' as new, sum((length(text) - length(replace(text, '{a}', ''))) // {len(a)})::bigint as n from documents" for a, b in RENAMES) + ") where n > 0 order by n desc, old limit 20")
def change_topk(v: Views) -> DataFrame:
    counts = F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"), F.floor((F.length("text") - F.length(F.replace("text", F.lit(a), F.lit("")))) / len(a)).alias("n")) for a, b in RENAMES))
    return v.table("documents").select(F.inline(counts)).groupBy("old", "new").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "old").limit(20)


@query(
    "dedupe_adjacent",
    r"""select doc_id, coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i = 1 or b[i - 1] <> b[i] or length(b[i]) < 4), lambda i: l[i]), ' '), '') as text
from (select doc_id, l, list_transform(l, lambda w: rtrim(w, ',.;:')) as b from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as l from documents))""",
)
def dedupe_adjacent(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", op.drop_adjacent_repeats(F.col("text")).alias("text"))


@query("clean_text", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def clean_text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", tx.collapse_space(F.col("text")).alias("text"))


@query("script_fold", "select doc_id, replace(replace(text, 'e', chr(4308)), 'a', chr(4304)) as folded, replace(replace(text, 'e', chr(4260)), 'a', chr(4256)) as unfolded from documents")
def script_fold(v: Views) -> DataFrame:
    """Old scripts are laid under the text first, so that folding has work to do; unfolding goes the other way."""
    old = F.translate("text", "ea", tx.ASOMTAVRULI[4] + tx.NUSKHURI[0])
    folded = tx.fold_script(old)
    return v.table("documents").select("doc_id", folded.alias("folded"), tx.unfold_script(folded).alias("unfolded"))


GENITIVE = "case when suffix({w}, 'is') then {w} when right({w}, 1) in ('a', 'e', 'i', 'y') then left({w}, length({w}) - 1) || 'is' when right({w}, 1) in ('o', 'u') then {w} || 's' else {w} || 'is' end"


@query("morph_suffix", f"select p_name, w, {GENITIVE.format(w='w')} as genitive from (select distinct p_name, split_part(p_name, ' ', 2) as w from part)")
def morph_suffix(v: Views) -> DataFrame:
    return v.table("part").select("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).distinct().withColumn("genitive", op.genitive(F.col("w")))


SUFFIXES, NOUNS = ("ში", "ს", "ის", "ად", ""), ("სახლი", "მთა", "წყარო", "ხე", "ქალაქ", "ძმათა")


@query(
    "suffix_join",
    """select word, suffix, case when suffix = '' then word
  when suffix in ('ში', 'ს') and right(word, 1) = 'ი' then left(word, length(word) - 1) || suffix
  when suffix = 'ის' then case when suffix(word, 'ის') or suffix(word, 'თა') then word when right(word, 1) in ('ი', 'ე', 'ა') then left(word, length(word) - 1) || 'ის' when right(word, 1) in ('ო', 'უ') then word || 'ს' else word || 'ის' end
  else word || suffix end as joined
from (select distinct ['სახლი', 'მთა', 'წყარო', 'ხე', 'ქალაქ', 'ძმათა'][p_partkey % 6 + 1] as word, ['ში', 'ს', 'ის', 'ად', ''][p_size % 5 + 1] as suffix from part)""",
)
def suffix_join(v: Views) -> DataFrame:
    """Georgian nouns with case endings and postpositions."""
    word = F.element_at(F.array(*(F.lit(w) for w in NOUNS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    suffix = F.element_at(F.array(*(F.lit(w) for w in SUFFIXES)), (F.col("p_size") % 5 + 1).cast("int"))
    return v.table("part").select(word.alias("word"), suffix.alias("suffix")).distinct().withColumn("joined", op.with_suffix(F.col("word"), F.col("suffix")))


ROOTS = {"the": "ze", "tion": "shun", "and": "und", "für": "for", "der": "სახლი"}


def _cases(word: str, then: str = "{put}") -> str:
    """A DuckDB case for the dictionary; ``then`` is what stands for a hit."""
    return f"case lower({word}) " + " ".join(f"when '{k}' then " + then.format(put=f"'{p}'") for k, p in ROOTS.items()) + f" else {word} end"


@query(
    "root_replace",
    "select doc_id, array_to_string(list_transform(regexp_extract_all(replace(text, 'der ', 'derში '), '[A-Za-z]+[ა-ჰ]*|[^A-Za-z]+'), lambda p: case when p = 'derში' then 'სახლში' when lower(p) = 'derში' then 'სახლში' else "
    + _cases("p") + " end), '') as text from documents",
)
def root_replace(v: Views) -> DataFrame:
    """Roots with a suffix glued to them lose the vowel that falls before it."""
    glued = F.replace("text", F.lit("der "), F.lit("derში "))
    return v.table("documents").select("doc_id", op.replace_roots(glued, ROOTS).alias("text"))


APOSTROPHES = [(end.replace("[იეა]", "[იეა]()").replace("[aeiy]", "[aeiy]()"), put) for end, put in op.apostrophe_rules()]


@query(
    "apostrophe_fix",
    "select doc_id, " + "".join("regexp_replace(" for _ in APOSTROPHES) + r"regexp_replace(text, '([a-z])([.,])', '\1''\2', 'g')"
    + "".join(rf", '{end}''(\s|$|[,.;:\-—()])', '{put.replace('$1', chr(92) + '1')}\2', 'g')" for end, put in APOSTROPHES) + " as text from documents",
)
def apostrophe_fix(v: Views) -> DataFrame:
    quoted = F.regexp_replace("text", r"([a-z])([.,])", "$1'$2")
    return v.table("documents").select("doc_id", op.fix_apostrophes(quoted).alias("text"))


@query("dict_replace", "select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+'), lambda p: " + _cases("p") + "), '') as text from documents")
def dict_replace(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", op.replace_words(F.col("text"), ROOTS).alias("text"))


REWRITES = [("[„“”]", '"'), (r"\bof the\b", "o'the"), (r"([a-z])\s+,", r"\1,"), (r"[#*$%&]{2,}", ""), (r"\s{2,}", " "), (r"[ ,;]+$", "")]
#: The twin has no look-around: a border is a character beside the words, and a second turn finds what shared it.
BORDERED = [x for a, b in REWRITES for x in ([(r"(^|[^\p{L}\p{N}_])of the([^\p{L}\p{N}_]|$)", r"\1o'the\2")] * 2 if r"\b" in a else [(a, b)])]


@query("rewrite_pipeline", "select doc_id, " + "".join("regexp_replace(" for _ in BORDERED) + "text" + "".join(", '{}', '{}', 'g')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in BORDERED) + " as text from documents")
def rewrite_pipeline(v: Views) -> DataFrame:
    """Rules in order.  Borders are those of letters, digits and ``_`` of any script."""
    border = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
    return v.table("documents").select("doc_id", op.rewrite(F.col("text"), [(a.replace(r"\b", border), b.replace("\\1", "$1")) for a, b in REWRITES]).alias("text"))


@query("guarded_replace", "select doc_id, case when contains(old, 'the') and lang = 'en' then replace(new, 'that', 'which') when contains(old, 'der') then replace(new, 'die', 'jene') else new end as new from verses join (select doc_id, lang from documents) d on d.doc_id = idx")
def guarded_replace(v: Views) -> DataFrame:
    """A replacement in one text that depends on its twin."""
    joined = v.verses().join(v.table("documents").select("doc_id", "lang"), F.col("idx") == F.col("doc_id"))
    new = F.when(F.contains("old", F.lit("the")) & (F.col("lang") == "en"), F.replace("new", F.lit("that"), F.lit("which"))).when(F.contains("old", F.lit("der")), F.replace("new", F.lit("die"), F.lit("jene"))).otherwise(F.col("new"))
    return joined.select("doc_id", new.alias("new"))


@query("phonetic", "select n_name, case when length(t) > 1 then left(t, 1) || replace(substr(t, 2), 'H', '') else t end as name from (select n_name, replace(case when right(n_name, 1) in ('1', '2') then left(n_name, length(n_name) - 1) || 'AH' else n_name end, 'TI', 'CHI') as t from nation)")
def phonetic(v: Views) -> DataFrame:
    t = F.replace(F.when(F.right("n_name", F.lit(1)).isin("1", "2"), F.concat(F.substring("n_name", F.lit(1), F.length("n_name") - 1), F.lit("AH"))).otherwise(F.col("n_name")), F.lit("TI"), F.lit("CHI"))
    bare = F.when(F.length(t) > 1, F.concat(F.substring(t, 1, 1), F.replace(F.substring(t, F.lit(2), F.length(t)), F.lit("H"), F.lit("")))).otherwise(t)
    return v.table("nation").select("n_name", bare.alias("name"))


@query("patch_once", "select idx, case when contains(new, old_part) then left(new, instr(new, old_part) - 1) || new_part || substr(new, instr(new, old_part) + length(old_part)) else new end as new, contains(new, old_part) as patched from verses join (values ('src3', 2, 'the', 'THE'), ('src5', 4, 'en', 'EN')) p(book_part, chapter, old_part, new_part) on contains(book_slug, book_part) and verses.chapter = p.chapter")
def patch_once(v: Views) -> DataFrame:
    """Patches addressed by book part and chapter replace the first occurrence only."""
    patches = v.spark.createDataFrame([("src3", 2, "the", "THE"), ("src5", 4, "en", "EN")], "book_part string, chapter int, old_part string, new_part string")
    joined = v.verses().join(F.broadcast(patches), "chapter").where(F.contains("book_slug", F.col("book_part")))
    at = F.expr("locate(old_part, new)")
    patched = F.concat(F.expr("substring(new, 1, locate(old_part, new) - 1)"), F.col("new_part"), F.expr("substring(new, locate(old_part, new) + length(old_part))"))
    return joined.select("idx", F.when(at > 0, patched).otherwise(F.col("new")).alias("new"), (at > 0).alias("patched"))


@query(
    "fix_validate",
    r"""select doc_id, regexp_extract_all(x, '\d+:\d+(?:-\d+)?') = regexp_extract_all(y, '\d+:\d+(?:-\d+)?') as refs_kept, length(y) >= length(x) * 0.4::double and length(y) <= length(x) * 2.5::double as length_ok,
  length(regexp_replace(y, '[^a-z]', '', 'g')) >= length(y) * 0.3::double as script_ok
from (select doc_id, text || ' ' || doc_id || ':1' as x, case doc_id % 3 when 0 then trim(regexp_replace(text, '\s+', ' ', 'g')) when 1 then text || text || text else '' end || ' ' || (doc_id - doc_id % 2) || ':1' as y from documents)""",
)
def fix_validate(v: Views) -> DataFrame:
    """Does a proposed correction keep its references, its rough length and its script?

    What is proposed is the text with its white space cleaned, three times itself, or nothing.
    """
    i = F.col("doc_id")
    x = F.concat("text", F.lit(" "), i.cast("string"), F.lit(":1"))
    proposed = F.when(i % 3 == 0, tx.collapse_space(F.col("text"))).when(i % 3 == 1, F.concat("text", "text", "text")).otherwise("")
    y = F.concat(proposed, F.lit(" "), (i - i % 2).cast("string"), F.lit(":1"))
    refs = lambda c: F.regexp_extract_all(c, F.lit(r"\d+:\d+(?:-\d+)?"), F.lit(0))
    fit = (F.length(y) >= F.length(x) * 0.4) & (F.length(y) <= F.length(x) * 2.5)
    return v.table("documents").select("doc_id", (refs(x) == refs(y)).alias("refs_kept"), fit.alias("length_ok"), (F.length(F.regexp_replace(y, "[^a-z]", "")) >= F.length(y) * 0.3).alias("script_ok"))


PENALTIES = "- 10 * least(len(regexp_extract_all(line, '[A-Z]{3,}')), 5) - case when length(line) > 200 then 10 else 0 end - case when length(line) < 5 then 50 else 0 end - case when regexp_matches(line, '[#*$%&]{3}') then 20 else 0 end"


@query("label_quality", f"select doc_id, pos, score, case when score >= 90 then 'perfect' when score >= 70 then 'good' when score >= 50 then 'fair' else 'bad' end as bucket from (select doc_id, pos, greatest(100 {PENALTIES}, 0)::int as score from (select doc_id, unnest(list) as line, unnest(range(len(list)))::int as pos from (select doc_id, string_split(text, chr(10)) as list from documents)))")
def label_quality(v: Views) -> DataFrame:
    """Every line of a text is a label."""
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.col("line")
    score = 100 - 10 * F.least(F.regexp_count(line, F.lit("[A-Z]{3,}")), F.lit(5)) - F.when(F.length(line) > 200, 10).otherwise(0) - F.when(F.length(line) < 5, 50).otherwise(0) - F.when(line.rlike("[#*$%&]{3}"), 20).otherwise(0)
    s = F.greatest(score, F.lit(0))
    return lines.select("doc_id", "pos", s.alias("score"), F.when(s >= 90, "perfect").when(s >= 70, "good").when(s >= 50, "fair").otherwise("bad").alias("bucket"))


@query("table_diff", "select coalesce(o.p_partkey, n.p_partkey) as p_partkey, case when o.p_partkey is null then 'added' when n.p_partkey is null then 'removed' else 'changed' end as kind, case when o.p_partkey is null or n.p_partkey is null then []::varchar[] else list_filter([case when o.p_name is distinct from n.p_name then 'p_name' end, case when o.p_size is distinct from n.p_size then 'p_size' end], lambda x: x is not null) end as changed from part o full join (select p_partkey + case when p_partkey % 97 = 0 then 1000000 else 0 end as p_partkey, case when p_partkey % 50 = 1 then upper(p_name) else p_name end as p_name, case when p_partkey % 75 = 1 then p_size + 1 else p_size end as p_size from part) n using (p_partkey) where o.p_partkey is null or n.p_partkey is null or o.p_name is distinct from n.p_name or o.p_size is distinct from n.p_size")
def table_diff(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    old = v.table("part").select("p_partkey", "p_name", "p_size")
    new = old.select((k + F.when(k % 97 == 0, 1000000).otherwise(0)).alias("p_partkey"), F.when(k % 50 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), F.when(k % 75 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return op.table_diff(old, new, "p_partkey", ["p_name", "p_size"])


@query("upsert", "select coalesce(b.p_partkey, u.p_partkey) as p_partkey, case when u.p_partkey is null then b.p_name else u.p_name end as p_name, case when u.p_partkey is null then 'kept' when b.p_partkey is null then 'added' when b.p_name = u.p_name then 'same' else 'updated' end as action from part b full join (select p_partkey * 2 as p_partkey, p_name from part) u using (p_partkey)")
def upsert(v: Views) -> DataFrame:
    part = v.table("part").select("p_partkey", "p_name")
    return op.upsert(part, part.select((F.col("p_partkey") * 2).alias("p_partkey"), "p_name"), "p_partkey", "p_name")


@query("dict_merge", "select key, value from (select *, row_number() over (partition by key order by s) as r from (select n_nationkey as key, n_name as value, 1 as s from nation union all select r_regionkey, r_name, 0 from region)) where r = 1")
def dict_merge(v: Views) -> DataFrame:
    first = v.table("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return op.first_source(first, v.table("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), key="key").select("key", "value")


@query("src_priority", "select key, text, source from (select *, row_number() over (partition by key order by s, key) as r from (select item_id as key, text, 'benchmark' as source, 0 as s from benchmark union all select doc_id, text, 'documents', 1 from documents)) where r = 1")
def src_priority(v: Views) -> DataFrame:
    """The first source that has a key supplies it."""
    first = v.table("benchmark").select(F.col("item_id").alias("key"), "text", F.lit("benchmark").alias("source"))
    second = v.table("documents").select(F.col("doc_id").alias("key"), "text", F.lit("documents").alias("source"))
    return op.first_source(first, second, key="key").select("key", "text", "source")


@query("src_union", "select 'documents' as source, count(*) as n, sum(length(text))::bigint as chars from documents union all select 'benchmark', count(*), sum(length(text))::bigint from benchmark")
def src_union(v: Views) -> DataFrame:
    both = v.table("documents").select(F.lit("documents").alias("source"), "text").unionByName(v.table("benchmark").select(F.lit("benchmark").alias("source"), "text"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("set_except", "select n_nationkey from nation except select s_nationkey from supplier where s_suppkey % 3 = 0")
def set_except(v: Views) -> DataFrame:
    return v.table("nation").select("n_nationkey").exceptAll(v.table("supplier").where("s_suppkey % 3 = 0").select("s_nationkey").distinct()).distinct()
