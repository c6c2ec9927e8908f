"""Fill-in-the-middle transformation: texts cut between words into prefix, middle and suffix, put in another order between sentinels."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_COLUMNS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def unit_starts(points: np.ndarray) -> np.ndarray:
    """Where units begin in code points, and the end. A unit is a word with the white space before it; white space at the end is one, too."""
    if not len(points):
        return np.zeros(1, dtype=np.int64)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    return np.concatenate(([0], np.flatnonzero(space[1:] & ~space[:-1]) + 1, [len(points)]))


def transform(text: str, key: str, percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of one text; the hash of ``key`` draws ranks and form."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = unit_starts(points)
    n = len(starts) - 1
    drawn = sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= percent or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(starts[low]), int(starts[high])
    before, middle, after = (points[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in ((0, a), (a, b), (b, len(points))))
    p, s, m = sentinels
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{after}{p}{before}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{before}{s}{after}{m}{middle}"


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``n`` (units), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars``, ``middle_chars`` (code points) and ``output`` to ``docs``.

    Two ranks among the units, drawn by the SHA-256 of ``seed:id``, bound the middle. ``percent`` of the texts are changed, ``spm_percent``
    of those with the suffix first; texts that hold a sentinel stay plain, as do null and empty ones, whose output is empty. A null id is
    drawn as ``null``. Rows are changed one by one, so repeats change alike; columns of ``docs`` that have a result's name are replaced.
    """

    @F.pandas_udf(", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(t, f"{seed}:{i}", percent, spm_percent, sentinels) for i, t in zip(ids, texts, strict=True)]
        return pd.DataFrame(rows, columns=list(_COLUMNS)).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    done = "_done"
    while done in docs.columns:
        done = f"_{done}"
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in _COLUMNS]
    return docs.withColumn(done, cut(key, text)).select(*kept, *[f"{done}.{c}" for c in _COLUMNS])


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    p, s, m = (F.lit(x) for x in sentinels)
    head, middle = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2))
    psm = F.concat(F.split_part(F.split_part(head, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), middle, F.split_part(F.split_part(head, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
