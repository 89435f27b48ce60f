"""The resumable walk against one listing of the whole tree."""

import os
import random
import shutil

import pytest
from pyarrow import fs

from inkwarden.sources import listing


def tree(top, seed=1, files=60):
    rng, made = random.Random(seed), {}
    folders = ["", "a", "a/b", "a-b", "b", "b/deep/er", "empty", "z"]
    for f in folders:
        os.makedirs(f"{top}/{f}", exist_ok=True)
    for k in range(files):
        path = f"{top}/{rng.choice(folders[:-2])}/f{k}.txt".replace("//", "/")
        made[path] = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 300)))
        with open(path, "wb") as f:
            f.write(made[path])
    os.symlink(next(iter(made)), f"{top}/a/link.txt")
    return made


def in_order(paths):
    return sorted(paths, key=lambda p: p.split("/"))


@pytest.mark.parametrize("entries,size", [(2000, 10**9), (7, 10**9), (1, 10**9), (2000, 500), (5, 300)])
def test_passes_take_each_file_once(tmp_path, entries, size):
    made = tree(str(tmp_path))
    reader, seen, at = listing.ListingReader({"path": str(tmp_path), "entries": str(entries), "bytes": str(size)}), [], None
    at = reader.initialOffset()
    for _ in range(1000):
        end, rows = reader._pass(at)
        assert len(rows) <= entries and (sum(e.length for e in rows) <= size or len(rows) == 1)
        seen += [e.path for e in rows]
        at = end
        if end["status"] == "COMPLETE":
            break
    assert seen == in_order(made) and at["walk"] == 1
    assert reader._pass(at)[0]["walk"] == 2


def test_only_folders_on_the_way_are_listed(tmp_path):
    made = in_order(tree(str(tmp_path)))

    listed, local = [], fs.LocalFileSystem()

    class Files:
        def get_file_info(self, x):
            if isinstance(x, fs.FileSelector):
                listed.append(x.base_dir)
            return local.get_file_info(x)

    got = [e.path for e in listing.walk(Files(), str(tmp_path), made[-2]) if e.length is not None and not os.path.islink(e.path)]
    assert got == made[-1:] and f"{tmp_path}/a/b" not in listed


def rows_of(spark, out):
    return spark.read.parquet(out)


def go(spark, top, out, state, **options):
    stream = spark.readStream.format("listing").options(path=top, cursor=f"{state}.cursor", **options).load()
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    """Each run is a pass; files that come behind the place are taken in this walk, those before it in the next."""
    spark.dataSource.register(listing.Listing)
    top, out, state = (str(tmp_path / x) for x in ("tree", "out", "state"))
    made = tree(top)
    for _ in range(3):
        go(spark, top, out, state, entries=20, slices=3)
    rows = rows_of(spark, out).collect()
    assert len({r.path for r in rows}) == len(rows) < len(made) and {r.status for r in rows} == {"PARTIAL"} and {r.number for r in rows} == {1, 2, 3}
    place = in_order(r.path for r in rows)[-1]
    assert sorted(r.path for r in rows) == sorted(p for p in made if p.split("/") <= place.split("/"))
    for name in ("a/0new.txt", "zz.txt"):
        with open(f"{top}/{name}", "wb") as f:
            f.write(b"new")
    for _ in range(10):
        go(spark, top, out, state, entries=20, slices=3)
        rows = rows_of(spark, out).collect()
        if {2} <= {r.walk for r in rows}:
            break
    one = {r.path: r for r in rows if r.walk == 1}
    assert set(one) == {*made, f"{top}/zz.txt"} and all(bytes(one[p].content) == b for p, b in made.items())
    assert sum(r.walk == 1 for r in rows) == len(one) and f"{top}/a/0new.txt" in {r.path for r in rows if r.walk == 2}


def test_a_lost_batch_is_done_again(spark, tmp_path):
    """The offsets in the checkpoint decide, whatever the cursor says."""
    spark.dataSource.register(listing.Listing)
    top, out, state = (str(tmp_path / x) for x in ("tree", "out", "state"))
    made = tree(top, files=30)
    for _ in range(2):
        go(spark, top, out, state, entries=10)
    for name in os.listdir(f"{state}/commits"):  # as if the driver had died before it said that the second batch is done
        if "1" in name:
            os.remove(f"{state}/commits/{name}")
    shutil.rmtree(f"{out}")
    reader = listing.ListingReader({"path": top, "entries": "10"})
    first, _ = reader._pass(reader.initialOffset())
    second, rows = reader._pass(first)
    go(spark, top, str(tmp_path / "out"), state, entries=10)
    got = rows_of(spark, out).filter("number = 2").collect()
    assert sorted(r.path for r in got) == sorted(e.path for e in rows) and set(made) >= {r.path for r in got}
    again = listing.ListingReader({"path": top, "entries": "10"}).partitions(first, second)
    assert sorted(e.path for s in again for e in s.entries) == sorted(e.path for e in rows)


def test_what_cannot_be_read(spark, tmp_path):
    top = str(tmp_path / "tree")
    os.makedirs(top)
    for name, size in (("large", 50), ("small", 5), ("gone", 3)):
        with open(f"{top}/{name}", "wb") as f:
            f.write(b"x" * size)
    reader = listing.ListingReader({"path": top, "largest": "10", "bytes": "20"})
    end, rows = reader._pass(reader.initialOffset())
    os.remove(f"{top}/gone")
    with open(f"{top}/small", "wb") as f:
        f.write(b"other content")
    got = {os.path.basename(p): (c, e) for b in reader.read(listing.Slice(rows, end)) for p, c, e in zip(*(b.column(k).to_pylist() for k in (0, 3, 4)))}
    assert got == {"large": (None, "INPUT_SIZE_LIMIT"), "small": (None, "CHANGED_WHILE_READ"), "gone": (None, "SCAN_UNAVAILABLE")}
    assert [e.error for e in listing.walk(fs.LocalFileSystem(), f"{top}/nowhere", None)] == ["DIRECTORY_UNREADABLE: FileNotFoundError"]
