"""The pipeline, stage by stage, on a small table."""

import hashlib
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import queries as llm_queries
from quillspark.plans.shared import written

from .test_corpus_operators import shingles, similar_links, union_find
from .test_text_operators import brute_rules


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf_dir))
        rows = docs.collect()
        kept.append(rows)
        if k < 4:
            assert docs.columns == columns
    good, unique, cut, mixed, ids = kept
    assert {r.doc_id for r in good} <= {i for i, t in before.items() if brute_rules(t)[0] >= 20}
    sets = {r.doc_id: shingles(r.text) for r in good}
    parts = union_find(similar_links(sets), sets)
    assert sorted(r.doc_id for r in unique) == sorted(i for i in sets if parts[i] == i)
    assert {r.doc_id for r in cut} <= {r.doc_id for r in unique} and all(len(r.text) == r.n_chars and re.search(r"\S", r.text) for r in cut)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in cut}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in mixed}
    assert len(ids) == len(mixed)
    for r in ids:
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.decoded_sha256) == (len(want), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(again) == sorted(ids)


CLASHING = ("n_removed", "n_sentences", "fate", "mark", "row", "unit", "copies", "class", "kept", "script", "outside")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)


def odd_rows():
    """Rows with nulls in each column, empty, very long, repeated and equal texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ".", ","]) for _ in range(n))
    passage, same = text(60), text(80)
    rows = [(i, text(rng.randint(40, 90)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"]), 100) for i in range(60)]
    rows += [(100 + i, f"{text(30)} {passage} {text(30)}", "en", "a", 100) for i in range(6)]
    rows += [(200, same, "en", "a", 7), (200, same, "en", "a", 7), (201, same, "en", "b", 7), (202, same.upper(), None, None, None), (None, text(50), "en", "a", 1), (None, same, "de", "a", 1)]
    rows += [(300, None, "en", "a", 0), (301, "", "en", "a", 0), (302, " \n\t", "en", "a", 3), (303, "too short", "en", "a", 9), (304, text(30_000), "en", "b", None), (305, "x" * 200_000, "en", "b", 200_000), (306, text(70), None, "a", 5), (307, text(70), "en", None, 5)]
    return rows, passage, same


def test_stages_with_odd_rows_and_clashing_names(spark, sf_dir):
    rows, passage, same = odd_rows()
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], SCHEMA)
    columns, found = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = written(stage(spark, docs, sf_dir))
        assert k == 4 or docs.columns == columns
        found.append(docs.collect())
        assert k == 4 or all(list(r)[5:] == list(range(len(CLASHING))) for r in found[-1])
    good, unique, cut, mixed, ids = found
    assert {300, 301, 302, 303, 305}.isdisjoint(r.doc_id for r in good) and 304 in {r.doc_id for r in good}
    assert sum(r.text == same for r in good) == 4 and sum(r.text.lower() == same for r in unique) == 1
    assert [r.doc_id for r in unique if r.text == same] == [200] and None in {r.doc_id for r in unique}
    assert sum(passage in r.text for r in unique) == 6 and sum(passage in r.text for r in cut) == 1
    assert all(r.n_chars == len(r.text) for r in cut if r.doc_id in range(101, 106))
    assert len(ids) == len(mixed) > 0
    # Each stage alone takes the rows as they come.
    raw = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, raw, sf_dir).collect()
        assert got and (k != 1 or sum(r.text is None for r in got) == 1)
    one = corpus_pipeline.near_duplicates(spark, raw, sf_dir)
    assert sorted(map(str, one.collect())) == sorted(map(str, corpus_pipeline.near_duplicates(spark, raw.repartition(5), sf_dir).collect()))


def test_all_operators_are_registered():
    names = llm_queries.queries()
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(llm_queries.oracle_sql()) <= set(names)
