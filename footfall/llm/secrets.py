"""Secret scans (operator 6): fixed patterns, and strings that zstandard cannot explain from their surroundings.

Each string in a sensitive context is measured by the bytes that it adds to the compressed surroundings, with a dictionary of
common identifiers already loaded; its own copies are blanked there. A string is in context shortly after a sensitive word,
or when only dots or line breaks part it from one that is, as in keys of several lines and dotted tokens. Strings that stay nearly as long as they are were not derived from words or code nearby,
and are reported as ``novel``.

Defined results: a null or empty text has no spans; spans are in code points, end exclusive; kinds may overlap each other;
equal texts get equal spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table
from .registry import register

KINDS = ["assign", "access", "hex", "novel"]

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs end where the class ends, so the shorter ones need no match of their own
HEX = re.compile(r"[0-9a-f]{24,}")

SENSITIVE = re.compile(r"(?:passw|passphrase|secret|token|api.?key|access.?key|private.?key|credential|bearer|authoriz|AKIA)",
                       re.A | re.I)
SHORTEST, LONG = 16, 4096
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Candidates have SHORTEST characters at least; one of more than LONG goes only to the next sensitive word inside it.
#: What may part a candidate from the one before that it goes on from (a backslash: line breaks written as \\n).
JOINT = re.compile(r"[.\\]|\s*[\r\n]\s*")
#: The short last line of a key.
LAST = re.compile(r"\s*[\r\n]\s*([A-Za-z0-9+/=]{1,15})(?=\s*[\r\n]\s*-----END)")
#: Characters after a sensitive word in which a candidate may start, and on each side of it that count as surroundings.
REACH, AROUND = 48, 240
#: Compressed bytes a character from which a string counts as incompressible, and the classes of characters it must mix.
NOVELTY, CLASSES = 0.6, 2

#: Identifiers and words that code and configuration use around secrets.
IDENTIFIERS = (
    "access account address admin application authorization basic bearer client config connection const credential database "
    "default define description development document email enable endpoint environment export false function header "
    "host identifier import key language license local message method model name none null number object option output "
    "parameter password path port private production project public query read request resource response return secret "
    "server service session setting source static string system target test text token true type update user username "
    "value version warning write aws_access_key_id aws_secret_access_key api_key apikey client_secret access_token "
    "refresh_token private_key public_key database_url password_hash BEGIN PRIVATE KEY END http https www com org"
)


class Novelty:
    def __init__(self) -> None:
        import zstandard

        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(
            level=9, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
        ).compress

    def __call__(self, text: str, start: int, end: int) -> float:
        """Bytes that the string adds to its compressed surroundings, for each of its characters."""
        size, core = end - start, text[start:end].strip("+/_=-")  # a copy may stand across the edge, or without its padding
        before = text[max(0, start - AROUND - size) : start].replace(core, " ")[-AROUND:]
        after = text[end : end + AROUND + size].replace(core, " ")[:AROUND]
        plain = (before + after).encode()
        whole = (before + after + text[start:end]).encode()
        return (len(self.compress(whole)) - len(self.compress(plain))) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates are listed once; each sensitive word begins at the first one that ends behind its start, so the time is in
    proportion to the text."""
    sensitive = [m.span() for m in SENSITIVE.finditer(text)]
    runs = [m.span() for m in CANDIDATE.finditer(text)] if sensitive else []
    ends = [e for _, e in runs]
    begins = [s for s, _ in sensitive]
    starts_taken, ends_taken = covered(base)
    judged: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, int, int]] = {}
    walked = 0  # what goes on from candidates before it was seen
    for near, near_end in sensitive:
        last = None  # end of the candidate before
        for i in range(bisect_right(ends, near), len(runs)):
            start, end = max(runs[i][0], near), ends[i]  # a word inside a run begins a shorter one
            if end - runs[i][0] > LONG:  # up to the next sensitive word inside it
                j = bisect_left(begins, start + SHORTEST)
                end = min(end, begins[j]) if j < len(begins) else end
            if end - start < SHORTEST:
                continue
            if start > near_end + REACH and (end <= walked or last is None or not JOINT.fullmatch(text, last, start)):
                break
            last, walked = end, max(walked, end)
            if end < ends[i]:
                last = None  # nothing goes on from a part
            value = text[start:end]
            if (start, end) in judged or start in found or mixture(value) < CLASSES:
                continue
            judged.add((start, end))
            j = bisect_right(ends_taken, start)
            if j < len(starts_taken) and starts_taken[j] < end:
                continue  # a fixed pattern reports it
            if novelty(text, start, end) >= NOVELTY:
                found[start] = (start, 3, end)
                if tail := LAST.match(text, end):
                    found[tail.start(1)] = (tail.start(1), 3, tail.end(1))
    return list(found.values())


def mixture(value: str) -> int:
    """How many of lower-case letters, capitals and digits a string has."""
    return sum(any(map(test, value)) for test in (str.islower, str.isupper, str.isdigit))


def scan(text: str | None, novelty: Novelty) -> tuple[list, list]:
    """Base spans, and all spans, both in order."""
    base = base_spans(text) if text else []
    return base, sorted(base + novel_spans(text, base, novelty)) if text else []



def find_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``base_spans`` and ``secret_spans``: arrays of (kind, start, end) over the whole text."""
    kind = "array<struct<kind:string,start:int,end:int>>"
    fields = [T.StructField(n, T._parse_datatype_string(kind)) for n in ("base_spans", "secret_spans")]

    def make():
        novelty = Novelty()

        def work(texts):
            rows = [scan(t, novelty) for t in texts]
            return [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in r[i]] for r in rows] for i in (0, 1)]

        return work

    return map_texts(df, make, fields, text, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; spans that overlap become one mark."""
    def make():
        novelty = Novelty()

        def clean(value: str | None) -> str | None:
            if not value:
                return value
            out, at = [], 0
            for start, _, end in scan(value, novelty)[1]:
                if start >= at:
                    out += [value[at:start], mark]
                at = max(at, end)
            return "".join(out) + value[at:]

        return lambda texts: [list(map(clean, texts))]

    return map_texts(df, make, [T.StructField(text, T.StringType())], text).select(*[F.col(f"`{c}`") for c in df.columns])


@register("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda name: F.array_join(
        F.transform(name, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base_spans"), 256).alias("base_sha256"),
        text("secret_spans").alias("spans"),
    )
