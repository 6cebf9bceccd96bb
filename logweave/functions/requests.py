"""Requests on the driver: canonical filters, tree transforms and JSON with big integers. No data passes here."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

BIG = "__bigint__"
SAFE = 1 << 53


class Absent:
    """Stands for a value that isn't there, unlike None, which is a value."""

    def __repr__(self) -> str:
        return "ABSENT"


ABSENT = Absent()


def transform(value: Any, *, sort_keys: bool = False, key: Callable | None = None, leaf: Callable | None = None, include: Callable | None = None) -> Any:
    """A rebuilt tree of dicts and lists: keys sorted and renamed, leaves mapped, entries of dicts kept where ``include(key, value)`` holds. Lists keep all elements."""
    if isinstance(value, dict):
        done = {(key(k) if key else k): transform(v, sort_keys=sort_keys, key=key, leaf=leaf, include=include) for k, v in value.items()}
        kept = {k: v for k, v in done.items() if include is None or include(k, v)}
        return dict(sorted(kept.items())) if sort_keys else kept
    if isinstance(value, (list, tuple)):
        return [transform(v, sort_keys=sort_keys, key=key, leaf=leaf, include=include) for v in value]
    return leaf(value) if leaf else value


def lower_hex(x: Any) -> Any:
    return x.lower() if isinstance(x, str) and x[:2] == "0x" else x


def drop_absent(value: Any) -> Any:
    """Without absent entries, and without dicts that this empties."""
    was_empty = lambda v: isinstance(v, dict) and not v
    if was_empty(value):
        return value
    return transform(value, include=lambda _, v: v is not ABSENT and not was_empty(v))


def canonical_filter(request: dict) -> dict:
    """A log request with sorted keys, lower-case hex, one form for equal address and topic sets."""
    out = transform(request, sort_keys=True, key=lower_hex, leaf=lower_hex, include=lambda _, v: v is not ABSENT and v != {})
    address = out.get("address")
    if isinstance(address, list):
        if not address:
            del out["address"]
        elif len(address) == 1:
            out["address"] = address[0]
    topics = out.get("topics")
    if topics is not None:
        flat = [(None if not t else t[0] if len(t) == 1 else t) if isinstance(t, list) else t for t in topics]
        if any(t is not None for t in flat):
            out["topics"] = flat
        else:
            del out["topics"]
    return out


def dumps(value: Any) -> str:
    """Compact JSON; integers beyond 53 bits as {"__bigint__": digits}."""
    big = lambda v: {BIG: str(v)} if isinstance(v, int) and not isinstance(v, bool) and abs(v) >= SAFE else v
    return json.dumps(transform(value, leaf=big), separators=(",", ":"), ensure_ascii=False)


def loads(text: str, strict: bool = False) -> Any:
    """The value of dumps(); ABSENT for broken text unless ``strict``."""
    try:
        return json.loads(text, object_hook=lambda d: int(d[BIG]) if set(d) == {BIG} else d)
    except ValueError:
        if strict:
            raise
        return ABSENT


def is_plain_object(value: Any) -> bool:
    return isinstance(value, dict)


def strip_options(params: list) -> tuple[list, dict | None]:
    """Parameters without a last one that is exactly a limiter's options, and these."""
    last = params[-1] if params else None
    if is_plain_object(last) and last.get("__rateLimiter") is True and set(last) <= {"__rateLimiter", "priority"}:
        priority = last.get("priority")
        if priority is None or isinstance(priority, (int, float)) and not isinstance(priority, bool):
            return params[:-1], last
    return params, None
