"""The Merkle manifest of op12, row by row."""

import hashlib
import zlib


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    said = [None if v is None else str(v).encode() for v in values]
    return hashlib.sha256(b"".join(b"-" if s is None else b"%d:%s" % (len(s), s) for s in said)).hexdigest()


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves, fan=8):
    """(root, [siblings left and right, level by level] of each leaf)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, own in enumerate(at):
            run = level[own // fan * fan : own // fan * fan + fan]
            paths[i].append(("".join(run[: own % fan]), "".join(run[own % fan + 1 :])))
        level = [sha(*level[i : i + fan]) for i in range(0, len(level), fan)]
        at = [own // fan for own in at]
    return level[0], paths


def manifest(rows):
    """rows: dicts of a document. Sorted tuples (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for r in rows:
        values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf_of(*values), leaf_of(*values[:4], lower(r["text"])) if tampered else leaf_of(*values)))
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in langs:
        groups[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[k] = tree([x[1] for x in groups[k]])
    root, over = tree([trees[k][0] for k in langs]) if langs else (None, [])
    out = []
    for k, more in zip(langs, over, strict=True):
        for (doc_id, leaf, own), path in zip(groups[k], trees[k][1], strict=True):
            folded = own
            for left, right in path + more:
                folded = sha(left, folded, right)
            out.append((doc_id, leaf, trees[k][0], root, sha(*(a + b for a, b in path + more)), folded, folded == root))
    return sorted(out, key=lambda x: tuple((y is not None, y) for y in x))
