"""Keys of one batch of many long texts leave in bounded lots."""

import numpy as np
import pyarrow as pa

from flowtide.llm import jaccard as j


def test_a_batch_gives_its_keys_in_bounded_lots():
    t, k, flush = j.Threshold(80, 100), 5, 20_000
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 3000))) for _ in range(60)]
    texts[7] = texts[50]  # copies in different lots
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    lots, keys, names = {}, set(), set()
    for n, out in enumerate(j._emit(k, t, 8, flush)(iter([batch]))):
        lots[n] = 0
        for met, blob in zip(out.column("met").to_pylist(), out.column("blob").to_pylist()):
            key, a, _ = j.unpack(blob)
            lots[n] += len(key) * (not met)
            keys |= set(zip(key.tolist(), a.tolist()))
            names |= set(a.tolist())
    buf, offs = j.utf8(batch.column(0))
    key, a, _ = j.part_keys(*j.sets_of(buf, offs, k), t)
    assert keys == set(zip(key.view(np.uint64).tolist(), a.tolist()))  # nothing is lost
    assert len(names) == len(set(texts))
    slice_keys = max(len(j.part_keys(*j.sets_of(buf[offs[i] : offs[m]], offs[i : m + 1] - offs[i], k), t)[0]) for i, m in j.slices(offs, j.SLICE))
    assert max(lots.values()) <= flush + slice_keys < len(key)
