"""Queries: per-user state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import userstate as op
from ..plans.adapters import Views
from ..plans.roster import Roster

roster = Roster()
query = roster.query


@query("reading_history", "select user_id, book, chapter, ts, r from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from (select user_id, book, chapter, max(ts) as ts, max_by(event_id, (ts, event_id)) as event_id from marks group by all)) where r <= 5")
def reading_history(v: Views) -> DataFrame:
    return op.reading_history(v.marks())


@query("user_dashboard", "select user_id, count(*) filter (where colour = 'yellow') as yellow, count(*) filter (where colour = 'green') as green, count(*) filter (where colour = 'blue') as blue, count(*) filter (where colour = 'pink') as pink, count(*) filter (where comment <> '') as comments, count(*) filter (where pinned) as pinned from marks group by 1")
def user_dashboard(v: Views) -> DataFrame:
    return op.dashboard(v.marks())


@query("bookmark_groups", "select user_id, book, chapter, count(*) as n, min(k) as first_verse, max(k) as last_verse, max_by(ts, event_id) as shown_ts from marks where action in ('purchase', 'view') group by all")
def bookmark_groups(v: Views) -> DataFrame:
    marks = v.marks().where(F.col("action").isin("purchase", "view"))
    return marks.groupBy("user_id", "book", "chapter").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_verse"), F.max("k").alias("last_verse"), F.max_by("ts", "event_id").alias("shown_ts"))


@query("tag_list", "select distinct user_id, unnest(tags) as tag from marks")
def tag_list(v: Views) -> DataFrame:
    return v.marks().select("user_id", F.explode("tags").alias("tag")).distinct()


@query("user_lists", "select event_id, user_id, colour, ts, r from (select *, row_number() over (partition by user_id order by case colour when 'yellow' then 0 when 'green' then 1 when 'blue' then 2 when 'pink' then 3 else 999 end, ts desc, event_id) as r from marks)")
def user_lists(v: Views) -> DataFrame:
    """All marks of a user, by colour and date; the window runs over one user's marks."""
    order = F.coalesce(*(F.when(F.col("colour") == c, i) for i, c in enumerate(op.COLOURS)), F.lit(999))
    w = Window.partitionBy("user_id").orderBy(order, F.desc("ts"), "event_id")
    return v.marks().withColumn("r", F.row_number().over(w).cast("bigint")).select("event_id", "user_id", "colour", "ts", "r")


@query("group_breaks", "select event_id, user_id, colour from (select *, lag(colour) over (partition by user_id order by ts, event_id) as before from marks) where before is null or before <> colour")
def group_breaks(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return v.marks().withColumn("before", F.lag("colour").over(w)).where("before is null or before <> colour").select("event_id", "user_id", "colour")


@query("user_state_join", "select m.event_id, m.user_id, m.k, v.book_slug, v.new from marks m left join verses v on v.verse = m.k and v.testament = 'new' where m.action = 'view'")
def user_state_join(v: Views) -> DataFrame:
    """Bookmarks keep their row if the verse is gone; keys are coerced to numbers."""
    verses = v.verses().where("testament = 'new'").select(F.col("verse").alias("k"), "book_slug", "new")
    return v.marks().where("action = 'view'").select("event_id", "user_id", "k").join(verses, "k", "left").select("event_id", "user_id", "k", "book_slug", "new")


@query("uniform_group", "select conv_id, count(*) as turns, count(*) > 1 and count(distinct role) = 1 as uniform from conversations group by 1")
def uniform_group(v: Views) -> DataFrame:
    return v.table("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), ((F.count(F.lit(1)) > 1) & (F.countDistinct("role") == 1)).alias("uniform"))


@query("time_ago", "select event_id, case when m < 1 then 'now' when h < 1 then m || 'm' when d < 1 then h || 'h' when d < 7 then d || 'd' else d // 7 || 'w' end as age from (select event_id, s // 60 as m, s // 3600 as h, s // 86400 as d from (select event_id, (epoch_us(timestamp '2024-01-31') - epoch_us(ts)) // 1000000 as s from events))")
def time_ago(v: Views) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, ts, timestamp_ntz'2024-01-31 00:00:00')")
    return v.table("events").select("event_id", op.age_label(seconds).alias("age"))


@query("input_limits", "select event_id, substr(repeat(comment || ' ', 20), 1, 99) as comment, list_filter(list_transform(tags, lambda t: substr(repeat(t, 20), 1, 30)), lambda t: t <> '') as tags from marks")
def input_limits(v: Views) -> DataFrame:
    comment = F.substring(F.repeat(F.concat("comment", F.lit(" ")), 20), 1, op.COMMENT_CHARS)
    tags = F.filter(F.transform("tags", lambda t: F.substring(F.repeat(t, 20), 1, op.TAG_CHARS)), lambda t: t != "")
    return v.marks().select("event_id", comment.alias("comment"), tags.alias("tags"))


SHOWN = '<a class="verse-link" data-slug="{slug}" data-chapter="\' || chapter || \'" data-verse="\' || k || \'" data-ref="{name} \' || chapter || \':\' || k || \'">{name} \' || chapter || \':\' || k || \'</a>'


@query(
    "note_links",
    "select event_id, '<h2>' || action || '</h2>' || chr(10) || '<ul>' || chr(10) || '<li>see ' || case when k % 2 = 0 then '"
    + SHOWN.format(slug="jn", name="John")
    + r"""' else '<span class="verse-link-invalid">[[Jon ' || chapter || ':' || k || ']]</span>' end || '</li>' || chr(10) || '<li><em>' || colour || '</em></li>' || chr(10) || '</ul>' || chr(10) || '<blockquote>a &lt; b &amp; <strong>c</strong></blockquote>' || chr(10) || chr(10) ||
  case when comment = '' then '' else comment || '<br>' end as html from marks""",
)
def note_links(v: Views) -> DataFrame:
    """Notes with a heading, a list with a link and emphasis, a quotation and a comment."""
    k = F.col("k").cast("string")
    name = F.when(F.col("k") % 2 == 0, "John").otherwise("Jon")
    note = F.concat(F.lit("# "), "action", F.lit("\n- see [["), name, F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), k, F.lit("]]\n- *"), "colour", F.lit("*\n> a < b & **c**\n\n"), "comment")
    return v.marks().select("event_id", tx.render_note(note, {"john": "jn", "1 john": "1jn"}).alias("html"))
