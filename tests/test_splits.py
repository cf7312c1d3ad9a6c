"""Readers that split: JSON maps cut at any byte, numpy archives by ranges of rows."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.sources import jsonmaps, npz
from quillspark.sources.places import opened


def some_map(seed, n=60):
    rng = random.Random(seed)
    letters = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "😀", "\n", "\\\\", '\\"', " "]

    def text():
        return "".join(rng.choices(letters, k=rng.randint(0, 12)))

    def value(depth):
        kind = rng.randint(0, 5 if depth < 4 else 2)
        if kind <= 1:
            return text()
        if kind == 2:
            return rng.choice([1, -2.5, None, True])
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {text() + str(i): value(depth + 1) for i in range(rng.randint(0, 3))}

    return {f"{i}{text()}": value(0) for i in range(n)}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_blocks_of_any_size_cut_the_same_entries(tmp_path, indent, size):
    made = some_map(size, 40)
    path = tmp_path / "map.json"
    path.write_text(json.dumps(made, ensure_ascii=False, indent=indent), encoding="utf-8")
    length, got, inside, depth = path.stat().st_size, {}, 0, 0
    with opened(f"file://{path}") as f:
        for at in range(0, length, size):
            for entry in jsonmaps._entries(f, length, at, size, inside, depth):
                row = jsonmaps.parsed(entry)
                assert row is None or row[0] not in got
                if row:
                    got[row[0]] = json.loads(row[1])
            odd, outside, within = jsonmaps._effect(f, at, size)
            depth, inside = depth + (within if inside else outside), inside ^ odd
    assert got == made and (inside, depth) == (0, 0)


def test_json_map_of_a_folder(spark, tmp_path):
    whole = {}
    for seed in range(3):
        made = {f"{seed}:{k}": v for k, v in some_map(seed).items()}
        whole |= made
        (tmp_path / f"{seed}.json").write_text(json.dumps(made, ensure_ascii=seed == 1), encoding="utf-8")
    (tmp_path / "empty.json").write_text(" { } ")
    (tmp_path / "blank.json").write_text("")
    got = jsonmaps.json_map(spark, f"file://{tmp_path}", 200)
    assert got.rdd.getNumPartitions() > 5
    assert {r.key: json.loads(r.value) for r in got.collect()} == whole


def test_long_entries_and_files_that_are_no_objects(spark, tmp_path):
    made = {"long": "x" * 100_000 + '"{', "next": [1, {"a": "}"}]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.json").write_text(json.dumps(made))
    assert {r.key: json.loads(r.value) for r in jsonmaps.json_map(spark, f"{tmp_path}/a", 1000).collect()} == made
    for text in ("[1, 2]", '{"a": 1'):
        (tmp_path / "a" / "m.json").write_text(text)
        with pytest.raises(Exception, match="JSON object"):
            jsonmaps.json_map(spark, f"{tmp_path}/a").collect()


def test_json_map_round_trip(spark, tmp_path):
    rows = [(f'k"{i}\\', json.dumps({"i": i, "t": "line\n" * i})) for i in range(30)] + [(None, "1"), ("none", None)]
    df = spark.createDataFrame(rows, "name string, doc string").repartition(4)
    jsonmaps.write_json_map(df, "name", "doc", f"file://{tmp_path}/out")
    got = jsonmaps.json_map(spark, f"file://{tmp_path}/out", 50)
    assert sorted((r.key, r.value) for r in got.collect()) == sorted(r for r in rows if None not in r)
    jsonmaps.write_json_map(df.where("false"), "name", "doc", f"file://{tmp_path}/none")
    assert jsonmaps.json_map(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_written_by_numpy(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    ids, vectors, names = np.arange(1000), rng.normal(size=(1000, 7)).astype(np.float32), np.array([f"n{i}é" for i in range(1000)])
    save(tmp_path / "a.npz", ids=ids, vectors=vectors, names=names, half=vectors.astype(np.float16)[:, 0])
    got = npz.read_npz(spark, f"{tmp_path}/a.npz", 2048)
    assert got.rdd.getNumPartitions() > 10
    rows = sorted(got.collect())
    assert [r.ids for r in rows] == ids.tolist() and [r.names for r in rows] == names.tolist()
    assert np.array_equal(np.array([r.vectors for r in rows], np.float32), vectors)
    assert dict(got.dtypes) == {"ids": "bigint", "vectors": "array<float>", "names": "string", "half": "float"}


def test_npz_round_trip_in_small_archives(spark, tmp_path):
    df = spark.range(0, 5000, 1, 3).select("id", F.array(F.col("id") * 0.5, F.col("id") * 2.0).alias("v"), F.concat(F.lit("t"), "id").alias("name"))
    assert npz.write_npz(df, f"{tmp_path}/out", 30_000) > 3
    assert sorted(npz.read_npz(spark, f"{tmp_path}/out", 10_000).collect()) == sorted(df.collect())
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".part")]
    with zipfile.ZipFile(next((tmp_path / "out").glob("*.npz"))) as z:
        assert sorted(z.namelist()) == ["id.npy", "name.npy", "v.npy"]
    with pytest.raises(FileExistsError):
        npz.write_npz(df, f"{tmp_path}/out")
    npz.write_npz(df.where("id < 0"), f"{tmp_path}/none")
    assert npz.read_npz(spark, f"{tmp_path}/none").count() == 0


def test_npz_refuses_what_it_cannot_hold(spark, tmp_path):
    for i, rows in enumerate(([(1, [1.0]), (None, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0, None])])):
        with pytest.raises(Exception, match="no nulls|several lengths"):
            npz.write_npz(spark.createDataFrame(rows, "id int, v array<double>").coalesce(1), f"{tmp_path}/{i}")
    np.savez(tmp_path / "o.npz", a=np.array([{}], object))
    with pytest.raises(Exception, match="numbers and texts|pickle|object"):
        npz.read_npz(spark, f"{tmp_path}/o.npz")
    with pytest.raises(FileNotFoundError):
        npz.read_npz(spark, f"{tmp_path}/0")
