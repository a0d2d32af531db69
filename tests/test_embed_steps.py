"""A batch of texts is embedded in steps that are handed out one by one."""

import pyarrow as pa

from siftwell.operators import embed


def test_no_step_holds_a_whole_batch():
    """10,000 short texts, or a few long ones, used to come out as one array."""
    for texts in (["few words", None, ""] * 3_333 + ["last"], [f"long{i} " * 20_000 for i in range(40)]):
        steps = list(embed._embedded(pa.array(texts), 384, True, True))
        assert len(steps) > 3
        assert all(len(s) == 1 or len(s) * 1024 + sum(len(t or "") for t in texts) * len(s) / len(texts) < 3 << 20 for s in steps)
        whole = embed._embed_texts(texts, 384, True, True)
        assert pa.concat_arrays(steps).to_pylist()[-50:] == whole.to_pylist()[-50:]
        assert sum(map(len, steps)) == len(texts)
    assert list(map(len, embed._embedded(pa.array([], pa.string()), 8, True, True))) == [0]
