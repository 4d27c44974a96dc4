"""The pipeline's rows against plain Python, stage by stage, on a small corpus whose answers follow from how it was made."""

import random

from tokenizers import Tokenizer

import corpus_pipeline
from footfall.llm import packing

KEY = "Qz8fK2pL9xWv3RtY7bNm"


def prose(seed, n=70):
    """Invented words; those of the labelled documents, which the toxicity model is fitted on, are not those of the others."""
    r = random.Random(seed)
    stock = ["river", "stone", "cloud", "garden"] if seed < 5000 else ["lamp", "spoon", "table", "mirror"]
    return " ".join(r.choice(stock) + r.choice("abcdefgh") * r.randint(1, 3) + str(r.randrange(50)) for _ in range(n))


def corpus():
    """(doc_id, text, what the packing should see of it, or None if the document goes) and toxic ids."""
    rows, toxic = [], set()
    for i in range(60):  # labelled documents, a third of them toxic
        text = prose(i)
        if i % 3 == 0:
            text += " you vile moron " + prose(1000 + i, 5)
            toxic.add(i)
        rows.append((i, text, None if i % 3 == 0 else text))
    rows.append((100, prose(5000) + " vile moron you", None))  # toxic, without a label
    shared = "\n".join(prose(6000 + j, 20) for j in range(4))
    rows += [(101, f"first {prose(6100)}\n{shared}", f"first {prose(6100)}\n{shared}"),
             (102, f"second {prose(6200)}\n{shared}\nend {prose(6201)}", f"second {prose(6200)}\nend {prose(6201)}"), (103, shared, None)]
    words = prose(7000, 80).split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows += [(104, " ".join(words), " ".join(words)), (105, near, None), (106, " ".join(words) + " ", None)]
    rows.append((107, f"Bearer: {KEY} {prose(8000)}", f"Bearer: [secret] {prose(8000)}"))
    rows += [(108, None, ""), (109, "", ""), (110, prose(9000, 3000), prose(9000, 3000))]
    return rows, toxic


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, toxic = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    encoder = Tokenizer.from_file(packing.vocabulary())
    wanted = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, _, t in rows if t is not None}
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert {i: sum(r["length"] for r in found) for i, found in pieces.items()} == wanted
    for found in pieces.values():
        found.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(len(found))) and all(r["length"] == 2048 for r in found[:-1])
    lengths = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(lengths.values()) <= 2048

    gaps = []  # best-fit decreasing, one piece at a time
    for n in sorted((r["length"] for r in packed), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((2048 if fit is None else fit) - n)
    assert len(lengths) == len(gaps)
