"""Phrases by positional postings against the scan of the texts."""

import random
import re

import pytest

from quillspark.operators import phrase as op
from quillspark.operators import search

WORDS = ["the", "thesis", "of", "Of", "a", "é", "x1", "in"]
GAPS = [" ", " ", " ", ", ", "  ", ". ", "\n", " - "]


@pytest.fixture(scope="module")
def verses(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    rows = [(i, t, texts[-i - 1] if i % 5 else None) for i, t in enumerate(texts)] + [(60, None, ""), (61, "", "..."), (62, "of the " * 3000, "the " * 3000), (63, " (of the)", "ofof the")]
    return spark.createDataFrame([(i, f"b{i % 3}", i % 4, i, new, old) for i, new, old in rows], "idx long, book_slug string, chapter int, verse int, new string, old string")


@pytest.fixture(scope="module")
def places(verses):
    sides = verses.selectExpr("idx", "inline(array(struct('new' as translation, new as text), struct('old' as translation, old as text)))")
    return op.positions(sides).cache()


@pytest.mark.parametrize("asked", ["of the", "of the of", "the the", "the the the", "a é x1", "Of, the", "in. the", "the of, the a", "of the of the of the", "x1", "the -", "in the thesis o", "é\n"])
@pytest.mark.parametrize("translation", ["both", "old"])
def test_places_find_what_a_scan_finds(verses, places, asked, translation):
    want = sorted(search.phrase_matches(verses, asked, translation).collect())
    assert sorted(op.matches(places, verses, asked, translation).collect()) == want
    assert want or len(asked) > 8


def test_places_are_bounded_and_plans_read_no_text(verses, places, spark, sf_dir):
    assert max(r.n for r in places.selectExpr("size(steps) as n").collect()) <= op.BLOCK
    first = places.where("token = 'of' and idx = 62").orderBy("steps").collect()
    assert len(first) == 6 and {len(r.steps) for r in first} >= {512} and {g for r in first for g in r.gaps} == {" "}
    with pytest.raises(ValueError):
        op.Phrase.parse(", of")
    assert op.Phrase.parse("a of a").overlaps and op.Phrase.parse("of o").overlaps and not op.Phrase.parse("of the").overlaps


def test_a_stored_index_answers_phrases_without_texts(spark, sf_dir, tmp_path):
    from quillspark.plans import index
    from quillspark.plans.adapters import Views
    from quillspark.queries.search import kw_phrase

    index.build(spark, sf_dir, f"{tmp_path}/index")
    try:
        plan = kw_phrase(Views(spark, sf_dir))._jdf.queryExecution().toString()
    finally:
        index.forget(spark, sf_dir)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all("text" not in columns for columns in read) and re.search(r"PushedFilters: \[.*StringStartsWith\(token,the\)", plan)
