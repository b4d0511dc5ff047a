"""Phone numbers whose base match takes in what follows them and fails: whole spans are added, never parts of a number."""

import random

from fathom.llm import pii

LEAD = "call my phone "
#: number, what follows it
FAILING = [("+1 (826) 555-4081", " 190.137.20.31"), ("+44 (20) 555-4081", " 12 34 56 78 90 12"), ("+1 415 555 0199", " 4111 1111 1111 1111"), ("+1-212-555-0142", " 20 30 40 50 60")]
#: no part of these is a number of its own
WHOLE = ["+1 (826) 555-4081-22-33-44-55-66", "(826 555-4081", "826) 555-4081", "1.826.555.4081.17"]


def test_whole_numbers_are_added(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [f"{word()} {LEAD}+1 (212) 555-01{i:02} {word()}" for i in range(60)]
    texts += [f"{word()} serial +0 {i:03} 1234 version 999.{i}.300.1 {word()}" for i in range(60)]
    wanted = {}
    for number, after in FAILING:
        at = f"{word()} {LEAD}"
        wanted[len(texts)] = (at, number)
        texts.append(f"{at}{number}{after} {word()}")
    first = len(texts)
    texts += [f"{word()} {LEAD}{x} {word()}" for x in WHOLE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("phone")] for r in pii.find(df).collect()}
    for i, (at, number) in wanted.items():
        whole = f"phone:{len(at)}:{len(at) + len(number)}"
        assert got[i] == ([] if number.startswith("+44 (20)") else [whole]), texts[i]
    for i in range(first, len(texts)):
        for span in got[i]:
            _, start, end = span.split(":")
            own = texts[i][int(start) : int(end)]
            assert own.count("(") == own.count(")") and texts[i][int(start) - 1] in " (" and texts[i][int(end)] == " ", (texts[i], own)
    assert all(len(got[i]) == 1 for i in range(60))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert all("[PHONE]" in clean[i] and "+1" not in clean[i] for i, (_, n) in wanted.items() if not n.startswith("+44"))
