"""What an operator makes of larger inputs grows with them."""

import numpy as np
import pytest

from patchloom.llm import language_model as L


@pytest.mark.parametrize("tokens", [1 << 30, (1 << 30) + 1, 1_360_000_000, 8_000_000_000, 2 << 40])
def test_parts_grow_with_the_tokens(tokens):
    """Past what one task deals to, a part is still worth its own cost: not a thousandth of what it is made for."""
    parts, wanted = L.parts_for(tokens), -(-tokens // L.PART)
    assert wanted <= parts <= max(L.LEAST * L.FAN, 2 * wanted) and (parts <= L.FAN or parts % L.FAN == 0)


def test_blocks_of_any_number_of_parts_reach_them(spark, monkeypatch):
    """Parts that are a multiple of a power of what one task deals to get all of their rows and no other's."""
    import pyarrow as pa

    monkeypatch.setattr(L, "FAN", 4)
    u, w, kinds = np.arange(3000) % 70, np.arange(3000) // 70 - 5, (np.int64,) * 3
    for wanted in (5, 17, 23, 63):
        parts = L.parts_for(wanted * L.PART)
        batch, fan = L._dealt(L.part_of(u, w, parts), 4, u, w, np.arange(3000)), 4
        while fan < parts:
            fan = min(parts, fan * 4)
            made = list(L._regrouped(kinds, fan, fan, iter([batch])))
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in made]) for k in range(2)], ["part", "block"])
        seen = []
        for p, b in zip(batch["part"].to_pylist(), batch["block"].to_pylist()):
            a, c, n = L.unpack(b, *kinds)
            assert p < parts and (L.part_of(a, c, parts) == p).all()
            seen += n.tolist()
        assert sorted(seen) == list(range(3000))
