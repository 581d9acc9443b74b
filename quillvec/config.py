"""The frozen description of an index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from quillvec.errors import IndexConfigError

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class IndexConfig:
    dim: int
    bits: int = 3
    shard_size: int = 100_000
    seed: int = 42
    normalize: bool = True
    value_range: float = 1.0
    rotation_kind: str = "haar"

    def __post_init__(self):
        if self.dim < 1:
            raise ValueError("an index needs at least one dimension")
        if self.bits not in (2, 3, 4):
            raise ValueError("bits must be 2, 3 or 4")
        if self.shard_size < 1:
            raise ValueError("a shard holds at least one row")
        if not self.value_range > 0:
            raise ValueError("value_range must be positive")
        if self.rotation_kind not in ("haar", "srht", "identity"):
            raise ValueError("rotation_kind must be haar, srht or identity")

    @property
    def top(self) -> int:
        """The highest level."""
        return 2**self.bits - 1

    @property
    def code_bytes(self) -> int:
        return -(-self.dim * self.bits // 8)

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"schema_version": SCHEMA_VERSION}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> IndexConfig:
        try:
            fields = json.loads(text)
            if fields.pop("schema_version", SCHEMA_VERSION) != SCHEMA_VERSION:
                raise IndexConfigError("unknown schema_version")
            return cls(**{k: v for k, v in fields.items() if k in cls.__dataclass_fields__})
        except (TypeError, ValueError) as e:
            raise IndexConfigError(f"unreadable index config: {e}") from e
