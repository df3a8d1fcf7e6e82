"""Roles, tokens and rate limits for the session facade."""

from __future__ import annotations

import hmac
import time
from dataclasses import dataclass, field
from enum import IntEnum

from .errors import FailedPrecondition, InvalidArgument, PermissionDenied, ResourceExhausted

GLOBAL_SHARE = 64


class Level(IntEnum):
    QUERY = 1
    ADMIN = 2


@dataclass(frozen=True)
class Principal:
    name: str
    level: Level


ANONYMOUS = Principal("anonymous", Level.QUERY)


def read_tokens(text: str) -> list[tuple[Principal, str]]:
    """Lines of name, role and token; # starts a comment."""
    out = []
    for line in text.splitlines():
        words = line.split("#")[0].split()
        if words:
            if len(words) != 3 or words[1] not in ("query", "admin"):
                raise InvalidArgument(f"not a token line: {line!r}")
            out.append((Principal(words[0], Level[words[1].upper()]), words[2]))
    return out


@dataclass
class Bucket:
    """A token bucket: ``rate`` a second, ``burst`` at once."""

    rate: float
    burst: float
    left: float = field(init=False)
    at: float = field(init=False, default=0.0)

    def __post_init__(self):
        self.left = self.burst

    def take(self, now: float) -> bool:
        self.left = min(self.burst, self.left + max(0.0, now - self.at) * self.rate) if self.at else self.burst
        self.at = now
        if self.left < 1:
            return False
        self.left -= 1
        return True


class Gate:
    """Authenticates, checks the role, then the principal's and the common rate.

    Without tokens anyone may query, and nobody may administer; that has to be asked for by ``insecure``.
    """

    def __init__(self, tokens: list[tuple[Principal, str]] | None = None, rate: float = 2000, burst: float = 2000, clock=time.monotonic, insecure: bool = False):
        if tokens is None and not insecure:
            raise FailedPrecondition("a gate without tokens is open to anyone: ask for it by insecure=True")
        self.tokens, self.rate, self.burst, self.clock = tokens, rate, burst, clock
        self.own: dict[str, Bucket] = {}
        self.common = Bucket(rate * GLOBAL_SHARE, burst * GLOBAL_SHARE)

    @property
    def mode(self) -> str:
        return "none" if self.tokens is None else "token"

    def principals(self) -> list[str]:
        return sorted({p.name for p, _ in self.tokens or []})

    def admit(self, token: str | None, level: Level) -> Principal:
        if self.tokens is None:
            who = ANONYMOUS
        else:
            found = [p for p, t in self.tokens if hmac.compare_digest(t.encode(), (token or "").encode())]
            if not found:
                raise PermissionDenied("unknown token")
            who = found[0]
        if who.level < level:
            raise PermissionDenied(f"{who.name} may not do this")
        now = self.clock()
        if not self.own.setdefault(who.name, Bucket(self.rate, self.burst)).take(now) or not self.common.take(now):
            raise ResourceExhausted(f"too many requests of {who.name}")
        return who
