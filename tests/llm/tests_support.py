"""Brute-force stages for the pipeline test."""

from test_dedup import brute_near


def brute_near_kept(rows, num=80):
    return {i for i, v in brute_near(list(rows.items()), num).items() if v[2]}


def brute_suffix_texts(rows, depth=100):
    seen, out = set(), {}
    for i in sorted(rows):
        b = (rows[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            w = b[k : k + depth]
            if w in seen:
                gone[k : k + depth] = b"\1" * depth
            else:
                seen.add(w)
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", errors="ignore")
    return out
