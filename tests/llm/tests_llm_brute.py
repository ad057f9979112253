"""Plain Python forms of results that SQL does not express."""


def brute_shingles(text, size=5):
    """The distinct shingles of so many words, of all words if they are fewer."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def brute_similarity(a, b):
    """The Jaccard similarity of the shingles of two texts; 1 if neither has a word."""
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_component_keepers(rows, similarity=0.8):
    """The least id of each group of documents linked by a similarity of so much or more."""
    texts = dict(rows)
    ids, keep, seen = sorted(texts), set(), set()
    for i in ids:
        if i in seen:
            continue
        keep.add(i)
        todo = [i]
        seen.add(i)
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in seen and brute_similarity(texts[a], texts[b]) >= similarity:
                    seen.add(b)
                    todo.append(b)
    return keep
