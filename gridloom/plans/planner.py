"""Which way an operator goes, decided by sizes that are known before it runs.

Shapes are static, so every bound is checked without a job. What is broadcast
has at most BROADCAST_ELEMENTS elements; beyond that both sides are shuffled.
"""

from __future__ import annotations

#: Elements of 16 to 40 bytes in an executor's memory: 64 MB at most.
BROADCAST_ELEMENTS = 1 << 20
#: A lane (the elements along one axis) up to this length is sorted or scanned within a task; longer ones are parted.
LANE = 1 << 20
#: Products of a matrix product up to which element rows are joined; more go in blocks.
JOIN_PRODUCTS = 1 << 24
BLOCK = 512
#: Block products that one task adds up before partial sums are combined.
BLOCKS_A_TASK = 64


def small(array) -> bool:
    return array.size <= BROADCAST_ELEMENTS


def dot_strategy(n: int, k: int, m: int, sparse: bool) -> str:
    """join: element rows by the inner axis; block: dense blocks, whose products NumPy forms."""
    return "join" if sparse or n * k * m <= JOIN_PRODUCTS else "block"
