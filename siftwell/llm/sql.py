"""SQL pieces that several twins need: CRC-32, which DuckDB has no function for."""

from __future__ import annotations

#: A common table expression with the 256 remainders as list ``t``.
CRC_TABLE = """crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) as r(i)
  )
)"""


def crc32(octets: str) -> str:
    """SQL for the checksum of a list of byte values, next to ``crc_table``."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, {octets}),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
