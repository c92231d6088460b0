import pyarrow as pa

from heronry.llm.columns import by_bytes


def test_portions_keep_every_row():
    batch = pa.record_batch([pa.array(["a" * n if n is not None else None for n in (3, 0, None, 9, 1, 1, 1, 40, 2)]), pa.array(range(9))], names=["t", "i"])
    for most in (1, 4, 10, 1000):
        parts = list(by_bytes(iter([batch, batch.slice(0, 0), batch.slice(2, 5)]), 0, most))
        assert [x for p in parts for x in p.column(1).to_pylist()] == [*range(9), *range(2, 7)]
        assert all(sum(len(x or "") for x in p.column(0).to_pylist()) <= most or len(p) == 1 for p in parts)
    assert len(list(by_bytes(iter([batch]), 0, 1000))) == 1
