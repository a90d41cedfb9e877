"""SQL that oracles of this package share."""

from __future__ import annotations


def crc_table(name: str = "crc_steps") -> str:
    """A common table expression with the 256 steps of CRC-32 in a list column `steps`."""
    shift = "b"
    for _ in range(8):
        shift = f"list_transform({shift}, lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)"
    return f"{name} AS MATERIALIZED (SELECT {shift} AS steps FROM (SELECT list_transform(range(0, 256), lambda i: i::UBIGINT) AS b))"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, a fold over them; needs `steps` in scope."""
    hexed = f"hex(encode({text}))"
    values = f"list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::UBIGINT)"
    fold = f"list_reduce(list_prepend(4294967295::UBIGINT, {values}), lambda acc, byte: xor(acc >> 8, steps[(xor(acc, byte) & 255)::INT + 1]))"
    return f"xor({fold}, 4294967295::UBIGINT)::BIGINT"
