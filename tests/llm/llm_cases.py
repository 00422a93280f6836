"""Documents with all that may go wrong, and a corpus of two made-up languages."""

import random

CLASHING = "n_words long, Size long, score string, fingerprint string, kept string, label string, x string, __text string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EXTRA = (7, 8, "s", "f", "k", "l", "x", "t")

EN = "the of and river stone house light under walked over garden window morning paper yellow letter".split()
DE = "der die und nicht haus straße über garten fenster morgen papier gelb brief licht stein für".split()


def prose(rng, words, n):
    out = []
    while len(out) < n:
        k = rng.randint(4, 12)
        sentence = [rng.choice(words) + (str(rng.randint(0, 99)) if rng.random() < 0.1 else "") for _ in range(k)]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + rng.choice(".!?")]
    return " ".join(out[:n])


def edge_rows():
    rng = random.Random(5)
    long_text = "\n".join(prose(rng, EN, 40) for _ in range(700))
    texts = [None, "", "   \n\t ", "one", "Two words", "...", "Ünïcödé straße 東京 𝒳𝒴 é", "<|endoftext|> a<|startoftext|>b", "\x1c \x85   x",
             "x" * 9000, long_text, long_text, prose(rng, DE, 60), prose(rng, EN, 60), "Idiot! idiot", "a b c d e a b c d e a b c d e",
             "MIT License. mit licens", "line\nline\n\nline \r\nline", "日本語のテキスト", "it's we'll don't  doesn't  \n\n x"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], 0, *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[13], rows[13]]  # the same row again
    rows += [(None, "no id at all", "en", "a", 0, *EXTRA), (None, None, None, None, None, *EXTRA), (13, "another text of the same id", "en", "a", None, *EXTRA)]
    return rows


def corpus_rows(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(rng, EN if lang == "en" else DE, rng.randint(5, 90)), lang, f"s{i % 4}", 0, *EXTRA))
    return rows
