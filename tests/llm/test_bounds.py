"""Memory bounds: the language model's files off a store that can't be mapped, the search's shards of very short texts."""

import subprocess
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow.fs as pafs

from quillwright.llm import common, lm, search


def test_model_files_are_let_go(tmp_path, monkeypatch):
    """40 files of 4 MB, a bound of 16 MB: no more than the bound and a file is held."""
    size = 500_000
    header = np.array([size] + [0] * (len(lm._FIELDS) - 1), np.int64).tobytes()
    for s in range(40):
        (tmp_path / f"tri-{s:06d}").write_bytes(header + np.arange(size, dtype=np.uint64).tobytes())
    remote = pafs.SubTreeFileSystem("/", pafs.LocalFileSystem())  # not a local one by its type
    monkeypatch.setattr(common, "filesystem", lambda path: (remote, path))
    arrays = lm._Arrays(SimpleNamespace(folder=str(tmp_path), there={"tri": set(range(40))}), common.Mapped(bound=16 << 20))
    tracemalloc.start()
    seen, most = 0, 0
    for _ in range(2):
        for rows, file in arrays.by_shard("tri", np.arange(40)):
            seen += len(rows) + (int(file.context[-1]) != size - 1)
            most = max(most, tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert seen == 80 and most < (16 << 20) + 2 * 8 * size


def test_shards_of_short_texts():
    """A million texts of one word: a worker's search stays under a gigabyte."""
    code = """
import resource, sys, tempfile
import numpy as np, pyarrow as pa
from quillwright.llm import search
from quillwright.llm.common import WordHashes, write_file
folder = tempfile.mkdtemp()
words = [b"w%d" % k for k in range(2000)]
memo = WordHashes()
terms = np.sort(memo.of(words[:300]))
n = 256
for name, x in (("ids", np.arange(n)), ("sizes", np.full(n, 300)), ("terms", terms), ("at", np.tile(np.arange(300), n).astype(np.int32)), ("weights", np.full(300, 2.0)), ("floor", np.zeros(n))):
    write_file(f"{folder}/b.{name}", x.tobytes())
run = search._search(folder, ["b"], 1.0, 10, False)
batches = (pa.record_batch({"doc_id": np.arange(lo, lo + 10_000), "text": [words[i % 2000].decode() for i in range(lo, lo + 10_000)]}) for lo in range(0, 1_000_000, 10_000))
got = sum(b.num_rows for b in run(batches))
print(got, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=common.__file__.rsplit("/quillwright", 1)[0]).stdout.split()
    assert int(out[0]) == 256 * 10 and int(out[1]) < 1000


def test_bound_of_sums():
    """Sums of as many 32-bit products as a bound adds up are within the bound's factor of the exact ones."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.random(search.DENSE + 2) ** rng.integers(1, 30) for _ in range(2))
        low = np.float32(0)
        for x, y in zip(a.astype(np.float32), b.astype(np.float32), strict=True):
            low += x * y
        assert (a * b).sum() <= float(low) * search._NEAR and float(low) <= (a * b).sum() * search._NEAR
