import os
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import bpe, tokenbin

BYTE = bpe.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.sampled_from([0.0, 0.5, 0.97, 1.0]))
def test_blocks_round_trip(ids, percentile):
    x = np.array(ids, np.uint32)
    data = tokenbin.file_bytes(x, [None, 5], [0, len(x)], percentile)
    f = tokenbin.TokenFile(data)
    assert f.doc_ids == [None, 5] and f.read(0, len(x)).tolist() == ids


def test_index_reads_any_range():
    x = np.random.default_rng(1).integers(0, 50_000, 20_000).astype(np.uint32)
    x[::500] = 4_000_000_000
    f = tokenbin.TokenFile(tokenbin.file_bytes(x, [1], [len(x)]))
    for lo, hi in ((0, 20_000), (4095, 4097), (9000, 9000), (8192, 12288), (19_999, 20_000)):
        assert (f.read(lo, hi) == x[lo:hi]).all()


def expect(rows):
    t = bpe.load(BYTE)
    want, at = Counter(), 0
    for d, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    return want


def test_files_of_odd_rows(spark, docs_of, odd_rows, tmp_path):
    for tokens in (4_000_000, 10):
        out = f"file://{tmp_path}/{tokens}"
        m = tokenbin.write_tokens(docs_of(odd_rows), out, BYTE, 2, file_tokens=tokens)
        assert Counter(map(tuple, tokenbin.read_tokens(m, out).collect())) == expect(odd_rows)
        assert all(f.endswith(".pfor") for f in os.listdir(f"{tmp_path}/{tokens}") if not f.endswith(".crc"))


def test_an_attempt_lost_between_the_steps_leaves_the_file(tmp_path):
    from pyarrow import fs

    class Dies(fs.LocalFileSystem):
        def delete_file(self, path):
            raise KeyboardInterrupt

    final = f"{tmp_path}/a"
    for k in range(3):
        own = f"{tmp_path}/.a.{k}"
        with open(own, "wb") as f:
            f.write(b"same")
        where = Dies() if k == 1 else fs.LocalFileSystem()
        try:
            tokenbin.publish(where, own, final)
        except KeyboardInterrupt:
            assert k == 1
        assert open(final, "rb").read() == b"same"
    assert sorted(os.listdir(tmp_path)) == [".a.1", "a"]


def test_a_second_call_has_files_of_its_own(docs_of, odd_rows, tmp_path):
    out = f"file://{tmp_path}/twice"
    tokenbin.write_tokens(docs_of(odd_rows), out, BYTE, 2)
    m = tokenbin.write_tokens(docs_of(odd_rows), out, BYTE, 2)
    assert Counter(map(tuple, tokenbin.read_tokens(m, out).collect())) == expect(odd_rows)


def test_empty_table(docs_of, odd_rows, tmp_path):
    m = tokenbin.write_tokens(docs_of(odd_rows).limit(0), f"file://{tmp_path}/none", BYTE, 2)
    assert tokenbin.read_tokens(m, f"file://{tmp_path}/none").count() == 0
