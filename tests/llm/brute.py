"""Plain versions of the operators' contracts, written apart from them."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def simhash(text) -> int:
    lowered = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict) -> dict:
    """Fingerprint to the least fingerprint reachable in steps of up to three bits."""
    left, out = set(prints), {}
    while left:
        seed = min(left)
        group, edge = {seed}, [seed]
        while edge:
            x = edge.pop()
            near = {y for y in left if y not in group and (x ^ y).bit_count() <= 3}
            group |= near
            edge += near
        out.update(dict.fromkeys(group, min(group)))
        left -= group
    return out


def near_duplicates(rows: list[tuple]) -> dict:
    """(id, text) rows to {id: (hexadecimal fingerprint, least id reachable)}, for distinct ids."""
    prints = {i: simhash(t) for i, t in rows}
    roots = components(set(prints.values()))
    least: dict = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    return {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def spans(kind: str, pattern: str, text: str, good, flags=0) -> list[tuple]:
    return [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if good(m)]


def secret_spans(text) -> list[tuple]:
    text = text or ""
    found = spans("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 8, re.I | re.A)
    found += spans("access", r"AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 16)
    found += spans("hex", r"[0-9a-f]+", text, lambda m: len(m[0]) >= 32)
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def personal_spans(text) -> list[tuple]:
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    found = spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, lambda m: True)
    found += spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split(".")))
    found += spans("card", r"[0-9]([\x20-]?[0-9])+", text, lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)))
    found += spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= len(digits(m)) <= 15)
    return found


def joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
