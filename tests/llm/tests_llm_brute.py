"""Plain versions of what operators compute, for tests."""

from functools import cache

from annals.llm.common import alnum_words, space_words


@cache
def tokenizer():
    from tokenizers import Tokenizer

    from annals.llm.tokens import default_path

    return Tokenizer.from_file(default_path())


def token_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def contaminated(text, items, window):
    ws = alnum_words(text)
    for _, t in items:
        p = alnum_words(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            if any(ws[k : k + m] == p[i : i + m] for k in range(len(ws) - m + 1)):
                return True
    return False


def near_groups(docs, percent, size=5):
    """The smallest id of each group of linked documents."""
    sets = {}
    for i, t in docs.items():
        w = space_words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                if label[j] < label[i] and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    label[i], changed = label[j], True
    return set(label.values())
