"""Small sequential models that the distributed operators are held against."""

from __future__ import annotations

from collections import OrderedDict


def divide(low, high, most, align=None):
    if low > high:
        return []
    if align:
        low, high = low // align * align, high // align * align + align - 1
    if most is None:
        return [(low, high)]
    return [(s, min(s + most - 1, high)) for s in range(low, high + 1, most)]


def merge(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def bisect(counts, low, high, cap):
    n = sum(v for b, v in counts.items() if low <= b <= high)
    if n <= cap or low == high:
        return [(low, high, n)]
    middle = low + (high - low + 1) // 2 - 1
    return bisect(counts, low, middle, cap) + bisect(counts, middle + 1, high, cap)


def bucket(arrivals, burst, per_token):
    """Start times under a token bucket that starts full, in continuous time."""
    tokens, stamp, out = float(burst), None, []
    now = None
    for a in arrivals:
        now = a if now is None else max(a, now)
        tokens = float(burst) if stamp is None else min(burst, tokens + (now - stamp) / per_token)
        if tokens < 1:
            now += (1 - tokens) * per_token
            tokens = 1.0
        tokens -= 1
        stamp = now
        out.append(round(now))
    return out


def lru(ops, budget):
    held, out = OrderedDict(), []
    for op, key, size in ops:
        hit = key in held
        if op == "get" and hit:
            held.move_to_end(key)
        if op != "get":
            held.pop(key, None)
        if op == "set" and size <= budget:
            while sum(held.values()) + size > budget:
                held.popitem(last=False)
            held[key] = size
        out.append((hit, sum(held.values())))
    return out


def cyrb(text, seed=0):
    """The public-domain 64-bit hash over UTF-16 units, as (high, low)."""
    raw = text.encode("utf-16-le", "surrogatepass")
    units = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
    m = 0xFFFFFFFF
    a, b = 0xDEADBEEF ^ seed, 0x41C6CE57 ^ seed
    for u in units:
        a, b = (a ^ u) * 2654435761 & m, (b ^ u) * 1597334677 & m
    low = ((a ^ a >> 16) * 2246822507 & m) ^ ((b ^ b >> 13) * 3266489909 & m)
    return ((b ^ b >> 16) * 2246822507 & m) ^ ((low ^ low >> 13) * 3266489909 & m), low


def limiter(requests, burst, per_token, slots):
    """Start times by sequence number, millisecond by millisecond; tokens in parts of ``per_token``."""
    todo, waiting, running, out = sorted(requests, key=lambda r: (r[0], r[1])), [], [], {}
    tokens, now = burst * per_token, 0
    while todo or waiting:
        while todo and todo[0][0] <= now:
            _, seq, duration, priority = todo.pop(0)
            waiting.append((float("inf") if priority is None else priority, seq, duration))
        running = [e for e in running if e > now]
        while waiting and len(running) < slots and tokens >= per_token:
            best = min(waiting)
            waiting.remove(best)
            tokens -= per_token
            out[best[1]] = now
            if best[2]:
                running.append(now + best[2])
        tokens, now = min(burst * per_token, tokens + 1), now + 1
    return out


def debounce(writes, gap, most, stale):
    """Upstream writes (key, at, seq, n), millisecond by millisecond."""
    out = []
    for key in {w[0] for w in writes}:
        todo, entry = sorted((at, seq) for k, at, seq in writes if k == key), None
        now = 0
        while todo or entry:
            if entry and min(entry[1] + gap, entry[0] + most) < now:
                due = min(entry[1] + gap, entry[0] + most)
                if due - entry[1] <= stale:
                    out.append((key, due, entry[2], entry[3]))
                entry = None
            while todo and todo[0][0] == now:
                _, seq = todo.pop(0)
                entry = (entry[0], now, seq, entry[3] + 1) if entry else (now, now, seq, 1)
            now += 1
    return out


def debounced(ops, o):
    """A debounced store, millisecond by millisecond: (seq, outcome, started, ended)."""
    todo = sorted(ops, key=lambda r: (r[0], r[1]))
    buffer, flying, flushes, out = {}, {}, [], []
    tokens, now = o.burst * 1000, 0

    def settled(key, version):
        for f in list(flushes):
            if key in f["keys"] and version >= f["keys"][key]:
                del f["keys"][key]
                if not f["keys"]:
                    flushes.remove(f)
                    out.append((f["seq"], "flushed", f["at"], now))

    def land():
        for key in sorted(flying):
            w = flying[key]
            if w["end"] <= now:
                del flying[key]
                late = w["duration"] >= o.timeout
                if key in buffer and buffer[key]["version"] == w["version"]:
                    del buffer[key]
                elif key in buffer and not late:
                    buffer[key]["first"] = buffer[key]["last"]
                out.append((w["seq"], "timeout" if late else "written", w["start"], now))
                settled(key, w["version"])

    while todo or buffer or flying:
        land()
        while todo and todo[0][0] == now:
            _, seq, key, op, duration = todo.pop(0)
            if op == "flush":
                if buffer:
                    flushes.append({"seq": seq, "at": now, "keys": {k: e["version"] for k, e in buffer.items()}})
                else:
                    out.append((seq, "flushed", now, now))
            else:
                old = buffer.get(key, {"first": now, "version": 0})
                buffer[key] = {"seq": seq, "first": old["first"], "last": now, "version": old["version"] + 1, "duration": duration}
        while True:
            for key in [k for k, e in buffer.items() if k not in flying and now - e["last"] > o.max_staleness]:
                e = buffer.pop(key)
                out.append((e["seq"], "stale", e["first"], now))
                settled(key, e["version"])
            ready = []
            for key, e in buffer.items():
                rank = max([len(flushes) - i for i, f in enumerate(flushes) if key in f["keys"]], default=0)
                due = min(e["last"] + o.debounce, e["first"] + o.max_delay)
                if key not in flying and (rank > 0 or due <= now):
                    ready.append((-rank, due, list(buffer).index(key), key))
            if not ready or tokens < 1000:
                break
            key = min(ready)[3]
            tokens -= 1000
            flying[key] = {**buffer[key], "start": now, "end": now + min(buffer[key]["duration"], o.timeout)}
            land()
        tokens, now = min(o.burst * 1000, tokens + o.per_second), now + 1
    return out
