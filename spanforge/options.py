"""Options of a run, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from spanforge.functions.tokens import key_bytes


@dataclass(frozen=True)
class Options:
    """Where to deliver, whose traffic to keep, the token key and the budgets."""

    url: str
    token_key: str
    namespaces: tuple[str, ...] = ()
    tenant: str = ""
    policy: str = ""
    allow_http: bool = False
    all_namespaces: bool = False
    batch_events: int = 200
    batch_bytes: int = 4 << 20
    queue_bytes: int = 64 << 20
    sample_rate: int = 100
    health_rate: int = 100
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        key_bytes(self.token_key)
        if not self.url.startswith("https://") and not (self.allow_http and self.url.startswith("http://")):
            raise ValueError("the receiver must be https unless allow_http is set")
        if not self.namespaces and not self.all_namespaces:
            raise ValueError("name the namespaces to keep or set all_namespaces")
        if min(self.batch_bytes, self.queue_bytes) < 64 << 10 or self.batch_events < 1:
            raise ValueError("budgets must be at least 64 KiB and one event")
        if not all(0 <= r <= 100 for r in (self.sample_rate, self.health_rate)):
            raise ValueError("rates are percentages")
