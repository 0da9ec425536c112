import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, kept string"
LETTERS = "abcdefghij"


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(LETTERS, k=draw.randint(2, 6))) for _ in range(words))


def changed(text, seed, times):
    draw, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def odd_texts():
    """Null, empty, white, one word, controls, other scripts, a very long word and a long text."""
    base = prose(1, 120)
    return [
        None, "", "  \n\t ", "word", "a\x0bb\r\nc\x0cd", base, base.upper(), f" {base} ", changed(base, 2, 3),
        changed(base, 3, 60), prose(4, 300), "é ü 日本 語。 𝔘 " * 40, "x" * 30_000, prose(5, 9000),
        "\n".join([prose(6, 12)] * 5 + [prose(7, 9)]), "go go go stop " * 30, base, base,
        'password = "hunter22" token:abc secret=a/b+c=9 API_KEY: "k.e-y_1234" passwd: x AKIA' + "Z" * 20
        + " " + "0123456789abcdef" * 3 + " AKIAABC -----BEGIN RSA PRIVATE KEY----- password=token:abcdefgh",
    ]


def rows(texts, sources=("s1", "s2", None)):
    out = [
        (n, text, "en", sources[n % len(sources)], None if text is None else len(text), "extra", "extra")
        for n, text in enumerate(texts)
    ]
    return [*out, out[5], out[5], (None, texts[5], None, "s1", None, None, None), (None, None, None, None, None, None, None)]


def frame(spark, records=None, schema=SCHEMA):
    return spark.createDataFrame(rows(odd_texts()) if records is None else records, schema)


def same_rows(one, two):
    return sorted(one, key=repr) == sorted(two, key=repr)
