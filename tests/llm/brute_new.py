"""Plain versions of packing, conversation repair and the manifest."""

import hashlib
import re
import zlib
from itertools import count

import numpy as np

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def pieces(text, tokenizer, end_id=1, length=4096):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
    for n in range(0, len(ids), length):
        part = ids[n:n + length]
        yield n // length, n, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part


def damaged(rows):
    """(conv_id, turn, role, text) rows by conversation, in order, after the damage."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def repaired(rows):
    """The contract's digest columns of one conversation, by comparing whole edit sequences."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] or " " for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    # last initial so far -> (cost, audit, repaired rows)
    best = {"": (0, "", ())}

    def inserts(states):
        for _ in range(4):
            for at, (cost, audit, done) in list(states.items()):
                for new, role in (("u", "user"), ("a", "assistant")):
                    found = (cost + 3, audit + "I", (*done, f"{role}:"))
                    if new in follows[at] and (new not in states or found < states[new]):
                        states[new] = found
        return states

    for (_, role, text), initial, fault in zip(rows, initials, faults):
        # several audits of one state are kept: an insertion at the end may or may not come first
        after = {}

        def offer(at, found):
            after[at] = min(after.get(at, found), found)

        before = [(at, x) for at, x in best.items()]
        before += [(at, x) for one, y in best.items() for at, x in inserts({one: y}).items()]
        for at, (cost, audit, done) in before:
            offer(at, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if initial in follows[at]:
                offer(initial, (cost + more, audit + "K", (*done, f"{role}:{text}")))
            for new, name in (("u", "user"), ("a", "assistant")):
                if new in follows[at]:
                    offer(new, (cost + 3 + more, audit + "R", (*done, f"{name}:{text}")))
        best = after
    ends = [x for at, x in best.items() if at in ("", "a")]
    ends += [x for one, y in best.items() for at, x in inserts({one: y}).items() if at in ("", "a")]
    cost, audit, done = min(ends)
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            hashlib.sha256("\n".join(done).encode()).hexdigest())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    """Top of a tree, and per node its siblings (left, right) by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    for _ in count():
        if len(nodes) == 1:
            return nodes[0], proofs
        for n, place in enumerate(at):
            run = place // 3 * 3
            proofs[n].append((nodes[run:place], nodes[place + 1:run + 3]))
        at = [place // 3 for place in at]
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]


def manifest(rows):
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of rows of
    (doc_id, source, lang, n_chars, text)."""
    if not rows:
        return []
    first_null = [(lambda r: (r[1] is not None, (r[1] or "").encode())),
                  (lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]
    rows = sorted(rows, key=lambda r: tuple(f(r) for f in first_null))
    groups = []
    for row in rows:
        if not groups or groups[-1][0][1] != row[1]:
            groups.append([])
        groups[-1].append(row)
    trees = [climbed([leaf(r) for r in g]) for g in groups]
    root, above = climbed([top for top, _ in trees])
    out = []
    for group, (subroot, proofs), outer in zip(groups, trees, above):
        for row, own in zip(group, proofs):
            key = "" if row[0] is None else str(row[0])
            shown = row
            if zlib.crc32(key.encode()) % 2 == 0 and row[4] is not None:
                shown = (*row[:4], row[4].replace("\n", ""))
            node = leaf(shown)
            for left, right in own + outer:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join(x for left, right in own + outer for x in [*left, *right]))
            out.append((row[0], leaf(row), subroot, root, proof, node, node == root))
    return out
