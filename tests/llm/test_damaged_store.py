"""A token store with damaged recipes or a damaged manifest isn't verified."""

import itertools
import shutil
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marginalia.llm import token_store
from marginalia.llm.tokenization import vocabulary

SIZE = token_store.DIGEST


def change(folder, edit):
    """Applies ``edit`` to the rows of the folder's files until it gives True."""
    for file in sorted(folder.glob("*.parquet")):
        table = pq.read_table(file)
        rows = table.to_pylist()
        if edit(rows):
            pq.write_table(pa.Table.from_pylist(rows, table.schema), file)
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            return
    raise AssertionError("nothing to damage")


def swapped(rows):
    for r in rows:
        lengths, digests = np.frombuffer(r["lengths"], "<u2"), [r["digests"][i : i + SIZE] for i in range(0, len(r["digests"]), SIZE)]
        for i, j in itertools.combinations(range(len(lengths)), 2):
            if lengths[i] == lengths[j] and digests[i] != digests[j]:
                digests[i], digests[j] = digests[j], digests[i]
                r["digests"] = b"".join(digests)
                return True
    return False


def replaced(rows):
    short = [r for r in rows if len(r["digests"]) == SIZE]
    for r, other in itertools.combinations(short, 2):
        if r["lengths"] == other["lengths"] and r["digests"] != other["digests"]:
            r["digests"] = other["digests"]
            return True
    return False


def exchanged(rows):
    """Another document's whole recipe, with its root."""
    if replaced(rows):
        by_digest = {}
        for r in rows:
            by_digest.setdefault(r["digests"], []).append(r)
        r, other = next(x for x in by_digest.values() if len(x) > 1)[:2]
        r["root"] = other["root"] = token_store.merkle_root([r["digests"]])
        return True
    return False


def miscounted(rows):
    rows[0]["docs"] += 1
    return True


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    rng, path = np.random.default_rng(5), tmp_path_factory.mktemp("whole") / "store"
    words = ["cat", "sat", "mat", "dog", "ran", "the", "one", "two", "red"]
    texts = [" ".join(rng.choice(words, n)) for n in [30000] * 2 + [20] * 12]
    token_store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), f"file://{path}", vocabulary("word_bpe_49k.json"), 2)
    assert token_store.verify_store(spark, f"file://{path}").count() == len(texts)
    return path


@pytest.mark.parametrize("folder, edit", [("recipes", swapped), ("recipes", replaced), ("recipes", exchanged), ("manifest", miscounted), ("recipes", None)])
def test_damage_is_found(spark, whole, tmp_path, folder, edit):
    path = Path(shutil.copytree(whole, tmp_path / "store"))
    if edit:
        change(path / folder, edit)
    else:
        sorted((path / folder).glob("*.parquet"))[0].unlink()
    with pytest.raises(Exception, match="damaged|manifest"):
        token_store.verify_store(spark, f"file://{path}").collect()
