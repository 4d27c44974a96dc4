"""Passages that stand several times in a row in one text, against brute force."""

import random

from footfall.llm import line_dedup

LEAST = line_dedup.MIN_WORDS


def passage(n_lines, n_words, seed):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(10**6)}" for _ in range(n_words)) for _ in range(n_lines)]


def left(lines):
    """Without every run of ``LEAST`` words or more that equals the run some lines earlier."""
    gone = set()
    for offset in range(1, len(lines)):
        run = []
        for i in range(offset, len(lines) + 1):
            if i < len(lines) and lines[i] == lines[i - offset]:
                run.append(i)
                continue
            if sum(len(lines[k].split()) for k in run) >= LEAST:
                gone.update(run)
            run = []
    return [x for i, x in enumerate(lines) if i not in gone]


def test_one_of_n_copies_in_a_row_stays(spark):
    texts, once = {}, {}
    for n in (1, 2, 3, 5, 10):
        for n_lines, n_words in ((1, 60), (1, 20), (4, 30), (25, 3)):
            part = passage(n_lines, n_words, 100 * n + n_lines + n_words)
            ends = passage(2, 5, 100 * n + n_lines + n_words + 5000)
            i = len(texts)
            texts[i], once[i] = [ends[0], *part * n, ends[1]], [ends[0], *part, ends[1]]
    rows = spark.createDataFrame([(i, "\n".join(x)) for i, x in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(rows).collect()}
    for i, lines in texts.items():
        assert got[i].text.split("\n") == left(lines)
        assert got[i].n_lines == len(lines) and got[i].n_removed == len(lines) - len(left(lines))
        if len(lines) - len(once[i]) and sum(len(x.split()) for x in once[i][1:-1]) >= LEAST:
            assert left(lines) == once[i]


def test_copies_in_a_row_of_a_later_text_all_go(spark):
    part = passage(3, 20, 1)
    rows = spark.createDataFrame([(0, "\n".join(part)), (1, "\n".join(["lead", *part * 3, "end"]))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(rows).collect()}
    assert got == {0: "\n".join(part), 1: "lead\nend"}
