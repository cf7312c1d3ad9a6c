"""Hand-made cases for what the tables cannot show."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import lexicon, quality, search, topics
from quillspark.plans.graph import connected_components
from quillspark.sources import readers


def one(spark, column, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).first().x


def test_token_classes(spark):
    text = "მძევალი ძე, ძე8 ძე ჱძე Straße Word"
    assert one(spark, tx.tokens(F.col("c0"), tx.GEORGIAN_SEARCH), text) == ["მძევალი", "ძე", "ძე", "ძე", "ძე"]
    assert one(spark, tx.tokens(F.col("c0"), tx.GEORGIAN_INDEX), text) == ["მძევალი", "ძე", "ძე", "ძე", "ჱძე", "stra", "e", "word"]
    assert one(spark, tx.count_word(F.col("c0"), "ძე"), text) == 2
    assert one(spark, tx.count_phrase(F.col("c0"), "ძე"), text) == 3


def test_search_parser():
    assert tx.parse_search('"a b"') == ("phrase", ["a b"])
    assert tx.parse_search("'a'") == ("phrase", ["a"])
    assert tx.parse_search('"')[0] == tx.parse_search('""')[0] == tx.parse_search("  ")[0] == "empty"
    assert tx.parse_search("One") == ("single", ["one"])
    assert tx.parse_search("one two") == ("and", ["one", "two"])
    assert tx.clamp_limit(-3, 50) == 0 and tx.clamp_limit(99, 50) == 50


def test_script_fold(spark):
    assert one(spark, tx.fold_script(F.col("c0")), "ႠႡ ⴀⴁ") == "აბ აბ"
    assert one(spark, tx.unfold_script(F.col("c0")), "აბ") == "ႠႡ"
    assert one(spark, tx.fold_archaic(F.col("c0")), "ჱჲ") == "ეი"


def test_highlight_escapes_first(spark):
    assert one(spark, search.mark_forms(F.col("c0"), F.lit("(?i)(ძე)")), "a<b & ძე") == "a&lt;b &amp; <mark>ძე</mark>"


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "idx long, score double")
    b = spark.createDataFrame([(2, 9.0), (3, 8.0)], "idx long, score double")
    got = {r.idx: r.rrf for r in search.reciprocal_rank_fusion(a, b).collect()}
    assert abs(got[2] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got[1] - 1 / 61) < 1e-12 and abs(got[3] - 1 / 62) < 1e-12


def test_lift(spark):
    baskets = spark.createDataFrame([(i, "t") for i in range(5)] + [(i, "u") for i in range(10)], "verse long, topic string")
    word = spark.createDataFrame([(0,), (1,), (2,), (7,)], "verse long")
    got = {r.topic: (r.c, r.lift, r.coverage, r.common) for r in topics.lift(baskets, word).collect()}
    assert got["t"] == (3, 1.5, 0.4, True)


def test_versification(spark):
    cases = {(8, 3, 4): [(8, 3, 4)], (10, 1, 1): [(9, 22, 22)], (23, 1, 6): [(22, 1, 6)], (115, 1, 3): [(113, 9, 11)], (116, 5, 12): [(114, 5, 9), (115, 1, 3)], (147, 10, 13): [(146, 10, 11), (147, 1, 2)], (151, 1, 2): [(151, 1, 2)]}
    df = spark.createDataFrame(list(cases), "chapter int, vs int, ve int")
    got = {}
    for r in topics.renumber(df).collect():
        got.setdefault((r.from_chapter, r.from_vs, r.from_ve), []).append((r.chapter, r.vs, r.ve))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in cases.items()}


def test_versification_of_other_books(spark):
    cases = {("malachi", 4, 1, 6): [(3, 19, 24)], ("malachi", 3, 1, 6): [(3, 1, 6)], ("nehemiah", 4, 16, 20): [(4, 16, 17), (4, 33, 35)], ("nehemiah", 4, 18, 18): [(4, 33, 33)], ("nehemiah", 4, 1, 17): [(4, 1, 17)], ("ruth", 4, 18, 19): [(4, 18, 19)], ("psalms", 10, 1, 2): [(9, 22, 23)]}
    got = {}
    for r in topics.renumber(spark.createDataFrame(list(cases), "book string, chapter int, vs int, ve int"), F.col("book")).collect():
        got.setdefault((r.book, r.from_chapter, r.from_vs, r.from_ve), []).append((r.chapter, r.vs, r.ve))
    assert {k: sorted(v) for k, v in got.items()} == cases


def test_osis(spark):
    refs = ["John.1.1-John.1.3", "John.1.50-John.2.2", "John.3.16", "nothing"]
    got = {r.ref: (r.book, r.chapter, r.vs, r.ve) for r in topics.parse_osis(spark.createDataFrame([(r,) for r in refs], "ref string"), "ref").collect()}
    assert got == {"John.1.1-John.1.3": ("John", 1, 1, 3), "John.1.50-John.2.2": ("John", 1, 50, 50), "John.3.16": ("John", 3, 16, 16), "nothing": (None, None, None, None)}


def test_upper_median(spark):
    assert topics.summary(spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int"), "x").first().upper_median == 3


def test_html_rows():
    merged = readers.merge_rows
    rows = [["1", "A", "1", "a"], [" ", "", "2", "b"], ["2", "B", "", ""], ["", "", "", "c"], ["2", "D", "", ""], ["x", "E", "3", "e"], ["4", "F", "f"]]
    assert merged(rows) == [(1, "A", "a"), (2, "B D", "b c"), (4, "F", "f")]
    assert merged([["1", "A", "2", "b"]]) == [(1, "A", "b")]  # the new number leads
    assert merged([["1", "A", "1", "a"], ["", "B", "", "b"]]) == [(1, "A", "a b")]  # without a number only the old text goes on
    assert merged([["4", "F", "f"], ["4", "G", "g"], ["4", "H", "4", "h"]]) == [(4, "F", "f"), (4, "G H", "g h")]  # three cells never merge, four do with the latest
    assert merged([["", "X", "y", "old"], ["", "", "", "lost"], ["A", "b", "c"], ["", "", "7", "  "], ["1", "2"]]) == []
    assert merged([["1", "A", "", ""], ["", "", "5", "e"], ["", "", "", "f"], ["5", "E", "5", "g"]]) == [(1, "A", ""), (5, "E", "e f g")]


def test_html_pages(spark):
    html = "<h1> Gen <i>esis</i></h1><h2>Chapter 1</h2><table><tr><th>1</th></tr><tr><td>1</td><td>A  <b>x</b> &amp; y</td><td>1</td><td>a</td></tr><tr><td>2</td><td>B</td>"
    got = readers.html_verses(spark.createDataFrame([(7, html), (8, None)], "id long, html string"), "id", "html").collect()
    assert [tuple(r) for r in got] == [(7, "Gen esis", "Chapter 1", 0, 1, "A x & y", "a")]  # an open row does not count


def test_notes(spark):
    books = {"john": "jn", "i kings": "1kg"}
    render = lambda note: one(spark, tx.render_note(F.col("c0"), books), note)
    assert render("# A\n## B\n### C\nplain") == "<h2>A</h2>\n<h3>B</h3>\n<h4>C</h4>\nplain<br>"
    assert render("- a\n* b\ntext\n- c") == "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\ntext<br>\n<ul>\n<li>c</li>\n</ul>"
    assert render("> q <b>\n\n**s** *e* ***") == "<blockquote>q &lt;b&gt;</blockquote>\n\n<strong>s</strong> <em>e</em> ***<br>"
    assert render("[[John 3:16]] [[I Kings 2:3-5]]") == '<a class="verse-link" data-slug="jn" data-chapter="3" data-verse="16" data-ref="John 3:16">John 3:16</a> <a class="verse-link" data-slug="1kg" data-chapter="2" data-verse="3" data-verse-end="5" data-ref="I Kings 2:3-5">I Kings 2:3-5</a><br>'
    assert render("[[Jon 3:16]] [[John]] [[]]") == '<span class="verse-link-invalid">[[Jon 3:16]]</span> <span class="verse-link-invalid">[[John]]</span> [[]]<br>'
    assert render("") == "" and one(spark, tx.render_note(F.col("c0"), books).isNull(), None) is True


def test_limits():
    assert [tx.clamp_limit(n, "references") for n in (-3, 0, 7, 50, 51)] == [0, 0, 7, 50, 50]
    assert tx.clamp_limit(5000, "keywords") == 2000 and tx.clamp_limit(9, 4) == 4


def test_suffixes(spark):
    cases = {("სახლი", "ში"): "სახლში", ("სახლი", "ის"): "სახლის", ("სახლი", "ს"): "სახლს", ("მთა", "ის"): "მთა", ("ხე", "ის"): "ხის", ("მთა", "ს"): "მთას", ("წყარო", "ის"): "წყაროს", ("ძმათა", "ის"): "ძმათა", ("კაცი", "ად"): "კაციად", ("კაცი", ""): "კაცი", ("", "ში"): ""}
    df = spark.createDataFrame([(*k,) for k in cases], "w string, s string")
    got = {(r.w, r.s): r.j for r in df.select("w", "s", quality.with_suffix(F.col("w"), F.col("s")).alias("j")).collect()}
    assert got == cases


def test_reference_text(spark):
    text = ["{Ge 1:1}", '"beginning"', "Pr_8:22-24, Joh_1:1", "Pr_8:22-24", "Reciprocal:", "Ge_2:1 - Thus", "{Zz 1:1}", "Pr_1:1"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, line string")
    got = sorted((r.source, r.book, r.chapter, r.vs, r.ve, r.type, r.topic, r.note) for r in readers.reference_text(lines, {"Ge": "genesis", "Pr": "proverbs", "Joh": "john"}).collect())
    assert got == [
        ("genesis:1:1", "genesis", 2, 1, 1, "reciprocal", "reciprocal", "Thus"),
        ("genesis:1:1", "john", 1, 1, 1, "thematic", "beginning", ""),
        ("genesis:1:1", "proverbs", 8, 22, 24, "thematic", "beginning", ""),
    ]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "book": "B", "chapter": 2}, {"id": 2, "new": "x"}]')
    (tmp_path / "m.json").write_text('{"k": {"a": 1}, "l": {"a": 2}}')
    (tmp_path / "l.jsonl").write_text('{"id": "1", "topicId": "t", "rawText": "r"}\n\n{"id": "2"}\n')
    rows = readers.json_array(spark, str(tmp_path / "a.json"), readers.VERSES).orderBy("id").collect()
    assert (rows[0].book, rows[0].new, rows[1].new) == ("B", "", "x")
    assert {r.key: r.value.a for r in readers.json_map(spark, str(tmp_path / "m.json"), "struct<a:int>").collect()} == {"k": 1, "l": 2}
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), readers.RAW_ENTRIES).count() == 2
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "m.json")]).endswith("m.json")
    out = readers.write_version(spark.range(3), str(tmp_path / "t"), "1", dry_run=False)
    assert spark.read.parquet(out).count() == 3 and readers.write_version(spark.range(3), str(tmp_path / "t"), "2").endswith("version=2")


def test_backup_round_trip(spark):
    state = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "user long, key string, value string")
    texts = readers.backup(state, "user")
    got = readers.valid_backups(texts, "backup", ["a"]).first()
    assert got.data == {"a": "x"}


def test_repairs(spark):
    assert one(spark, quality.drop_adjacent_repeats(F.col("c0")), "წესი წესი, და და") == "წესი და და"
    assert one(spark, quality.genitive(F.col("c0")), "rosa") == "rosis"
    assert one(spark, quality.fix_apostrophes(F.col("c0")), "rosa' flo' in'") == "rosis flos in"
    assert one(spark, quality.replace_roots(F.col("c0"), {"peter": "პეტრე"}), "Peterს და paul") == "პეტრეს და paul"
    assert one(spark, quality.replace_words(F.col("c0"), {"god": "ღმერთი"}), "God godly god") == "ღმერთი godly ღმერთი"
    assert one(spark, quality.first_reason(F.col("c0"), [("[0-9]", "digits"), ("x", "x")]), "x1") == "digits"


def test_bm25_by_hand(spark):
    import math

    counts = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("a", 2, 1)], "token string, idx long, tf long")
    verses = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "idx long")
    got = {r.idx: r.score for r in search.bm25(counts, verses, spark.createDataFrame([("a",)], "form string")).collect()}
    idf, avgdl = math.log(5 - 2 + 0.5) - math.log(2.5), 4 / 5
    want = {1: idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), 2: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / avgdl))}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(got) == 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 5), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in parent}
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: c for x, c in want.items()}
    import quillspark.plans.graph as graph

    limit, graph.ONE_TASK_EDGES = graph.ONE_TASK_EDGES, 1
    try:
        assert {r.node: r.component for r in connected_components(df).collect()} == got
    finally:
        graph.ONE_TASK_EDGES = limit


def test_prefix_groups(spark):
    words = spark.createDataFrame([(w, 9) for w in ("abcdefgh", "abcdefghi", "abcdefghij", "abcdeZ", "zzzzzz")], "token string, n long")
    got = {r.form: r.lemma for r in lexicon.prefix_groups(words, lexicon.prefix_pairs(words)).collect()}
    assert got == {"abcdefgh": "abcdefgh", "abcdefghi": "abcdefgh", "abcdefghij": "abcdefgh", "abcdeZ": "abcdeZ", "zzzzzz": "zzzzzz"}


def test_postings_equal_scan(spark, sf_dir):
    """Index totals agree with a scan where no digit touches a word."""
    from quillspark.plans.adapters import Views

    v = Views(spark, sf_dir)
    indexed = v.postings().where("token = 'the'").agg(F.sum("cnt")).first()[0]
    scanned = v.sides().agg(F.sum(tx.count_word(F.col("text"), "the"))).first()[0]
    assert indexed == scanned


def test_stream_history(spark, sf_dir, tmp_path):
    from quillspark.operators.userstate import reading_history
    from quillspark.plans.adapters import Views
    from quillspark.streaming import history

    marks = Views(spark, sf_dir).marks().select("event_id", "user_id", "ts", "book", "chapter", F.col("action").alias("event_type"))
    marks.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = history.history(stream).writeStream.outputMode("update").format("memory").queryName("hist").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    got = spark.sql("select * from hist").toPandas()
    want = reading_history(marks).toPandas()
    last = {(u, r): (b, c) for u, b, c, r in zip(got.user_id, got.book, got.chapter, got.r)}  # later updates overwrite
    assert last == {(u, r): (b, c) for u, b, c, r in zip(want.user_id, want.book, want.chapter, want.r)}
    assert isinstance(got, pd.DataFrame)
    batch = history.windowed_counts(marks).agg(F.sum("n")).first()[0]
    assert batch == marks.count()


def test_stream_positions_expire(spark, tmp_path):
    from quillspark.streaming import history

    at = lambda day, hour: pd.Timestamp(2024, 1, day, hour).to_pydatetime()
    steps = [[(1, 7, at(1, 8), "gen", 1), (2, 7, at(1, 9), "gen", 2), (3, 8, at(1, 9), "exo", 5)], [(4, 8, at(2, 1), "exo", 6), (5, 9, at(2, 20), "lev", 1)], [(6, 9, at(3, 23), "lev", 2)], [(7, 5, at(4, 1), "num", 1)]]
    schema = "event_id long, user_id long, ts timestamp, book string, chapter int"
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = history.saved_positions(stream).writeStream.outputMode("update").format("memory").queryName("positions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    got = {(r.user_id, r.book, r.chapter, r.live) for r in spark.sql("select * from positions").collect()}
    assert {(7, "gen", 2, True), (8, "exo", 6, True), (9, "lev", 2, True), (7, "gen", 2, False)} <= got and (9, "lev", 2, False) not in got


def test_stream_keeps_last_write(spark, tmp_path):
    from quillspark.streaming import history

    schema = "k long, ts long, note string"
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b"), (1, 3, "c")], [(1, 2, "late"), (2, 5, "d")], [(3, 1, "e")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    history.keep_last(stream, str(tmp_path / "out"), ["k"], ["ts", "note"]).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    assert sorted(map(tuple, history.latest(spark, str(tmp_path / "out")).collect())) == [(1, 3, "c"), (2, 5, "d"), (3, 1, "e")]


def test_encoders(spark):
    from quillspark.operators import encode

    rows = spark.createDataFrame([(1, "Ab ac bad"), (2, None), (3, "")], "id long, text string")
    got = {r.key: list(r.vec) for r in encode.encoded(rows, "id", "text", encode.first_letters, batch=2).collect()}
    assert abs(got[1][0] - 2 / 5**0.5) < 1e-6 and abs(got[1][1] - 1 / 5**0.5) < 1e-6 and set(got[2] + got[3]) == {0.0}
    scored = encode.rescored(rows, "id", "text", "bad", lambda: lambda q, texts: [float(q in t) for t in texts], batch=2)
    assert {r.key: r.score for r in scored.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_versions_and_changes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "ბ"), (3, "c")], "k long, v string")
    target = readers.write_version(old, str(tmp_path / "t"), "1", dry_run=False, kind="json")
    assert sorted((r.k, r.kind) for r in readers.changes(new, target, "k", ["v"], "json").collect()) == [(1, "removed"), (2, "changed"), (3, "added")]
    target = readers.write_version(new, str(tmp_path / "t"), "2", dry_run=False, kind="json")
    assert "ბ" in "".join(p.read_text() for p in (tmp_path / "t" / "version=2").glob("*.json"))


def test_rewrite_pipeline_keeps_texts_with_accents(spark, tmp_path):
    import re

    from quillspark.queries import AREAS, quality

    texts = ["café of the day", "éof the x", "of theé x", "out of the é of the", "„a“ of the b  , c ## ;", "über of the_ of the-of the", "ასof the", "of the", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in next(a.queries["rewrite_pipeline"] for a in AREAS if "rewrite_pipeline" in a.queries)(spark, str(tmp_path)).collect()}

    def rewritten(text):
        for a, b in quality.REWRITES:
            text = re.sub(a, b, text)
        return text

    assert got == {i: t if t is None else rewritten(t) for i, t in enumerate(texts)}


def test_whole_text_queries(spark, tmp_path):
    import re

    from quillspark.queries import AREAS

    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "alpha,", "alpha.", "beta", "of", "of,", "é", ";;", "3:16", "gamma-"])
    docs = {i: rng.choice(["", " "]) + rng.choice([" ", "  ", "\n"]).join(word() for _ in range(400)) for i in range(12)} | {12: "", 13: "one"}
    items = {i: "".join(rng.choice("abé ") for _ in range(150)) for i in range(4)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: next(a.queries[name] for a in AREAS if name in a.queries)(spark, str(tmp_path)).collect()

    def deduped(text):
        out = []
        for w in text.split():
            if not (out and out[-1].rstrip(",.;:") == w.rstrip(",.;:") and len(w.rstrip(",.;:")) > 3):
                out.append(w)
        return " ".join(out)

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1]

    def valid(i, text):
        x, y = f"{text} {i}:1", f"{[' '.join(text.split()), text * 3, ''][i % 3]} {i - i % 2}:1"
        refs = lambda t: re.findall(r"\d+:\d+(?:-\d+)?", t)
        return refs(x) == refs(y), 0.4 * len(x) <= len(y) <= 2.5 * len(x), len(re.sub("[^a-z]", "", y)) >= 0.3 * len(y)

    assert {r.doc_id: r.text for r in run("dedupe_adjacent")} == {i: deduped(t) for i, t in docs.items()}
    assert {r.doc_id: r.folded for r in run("script_fold")} == {i: t.replace("e", chr(4308)).replace("a", chr(4304)) for i, t in docs.items()}
    assert {(r.a, r.b): r.distance for r in run("edit_distance")} == {(i, i + 1): distance(items[i], items[i + 1]) for i in range(3)}
    assert {(r.a, r.b): r.distance for r in run("edit_distance_block")} == {(i, j): distance(items[i], items[j]) for i in items for j in items if i < j and items[i][:2] == items[j][:2]}
    assert {r.doc_id: tuple(r)[1:] for r in run("fix_validate")} == {i: valid(i, t) for i, t in docs.items()}
    assert {r.key: (r.text, r.source) for r in run("src_priority")} == {i: (t, "documents") for i, t in docs.items()} | {i: (t, "benchmark") for i, t in items.items()}
