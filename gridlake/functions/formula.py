"""Formula text: shifting relative references and marking newer functions. Nothing is evaluated."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.errors import AuthoringError

#: Functions that are stored with a prefix because they came after the file format (fixed values).
MODERN = set(
    """FILTER SORT SORTBY UNIQUE SEQUENCE RANDARRAY XLOOKUP XMATCH LAMBDA LET BYROW BYCOL MAKEARRAY MAP REDUCE SCAN ISOMITTED VSTACK HSTACK TOROW TOCOL WRAPROWS WRAPCOLS TAKE DROP EXPAND
    CHOOSEROWS CHOOSECOLS TEXTJOIN CONCAT TEXTBEFORE TEXTAFTER TEXTSPLIT ARRAYTOTEXT VALUETOTEXT IFS SWITCH MAXIFS MINIFS AGGREGATE ACOT ACOTH COT COTH CSC CSCH SEC SECH ARABIC BASE DECIMAL
    COMBINA PERMUTATIONA GAMMA GAUSS PHI MUNIT BITAND BITOR BITXOR BITLSHIFT BITRSHIFT IMCOSH IMCOT IMCSC IMCSCH IMSEC IMSECH IMSINH IMTAN DAYS ISOWEEKNUM IFNA NUMBERVALUE SHEET SHEETS
    FORMULATEXT ISFORMULA ENCODEURL WEBSERVICE FILTERXML UNICHAR UNICODE XOR PDURATION RRI BETA.DIST BETA.INV BINOM.DIST BINOM.DIST.RANGE BINOM.INV CHISQ.DIST CHISQ.DIST.RT CHISQ.INV
    CHISQ.INV.RT CHISQ.TEST CONFIDENCE.NORM CONFIDENCE.T COVARIANCE.P COVARIANCE.S EXPON.DIST F.DIST F.DIST.RT F.INV F.INV.RT F.TEST GAMMA.DIST GAMMA.INV GAMMALN.PRECISE HYPGEOM.DIST
    LOGNORM.DIST LOGNORM.INV MODE.MULT MODE.SNGL NEGBINOM.DIST NORM.DIST NORM.INV NORM.S.DIST NORM.S.INV PERCENTILE.EXC PERCENTILE.INC PERCENTRANK.EXC PERCENTRANK.INC POISSON.DIST
    QUARTILE.EXC QUARTILE.INC RANK.AVG RANK.EQ SKEW.P STDEV.P STDEV.S T.DIST T.DIST.2T T.DIST.RT T.INV T.INV.2T T.TEST VAR.P VAR.S WEIBULL.DIST Z.TEST CEILING.PRECISE FLOOR.PRECISE
    ISO.CEILING ERF.PRECISE ERFC.PRECISE""".split()
)
_PIECE = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*'!?|\[[^\]]*\])|(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)(\d{1,7})(?![A-Za-z0-9_.(!])|(?<![A-Za-z0-9_.])((?:_xlfn\.|_xlws\.)*)([A-Za-z][A-Za-z0-9.]*)(?=\()|([A-Za-z_\\][A-Za-z0-9_.]*)""")


def _col(s: str) -> int:
    n = 0
    for c in s:
        n = n * 26 + ord(c) - 64
    return n


def _letters(n: int) -> str:
    if not 1 <= n <= 16384:
        raise AuthoringError(f"column {n} lies outside the grid")
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def translate(formula: str, d_col: int, d_row: int) -> str:
    """Relative references move by the offsets; ``$`` pins an axis; text, sheet names and brackets stay."""

    def one(m: re.Match) -> str:
        if m[3] is None:
            return m[0]
        col = m[3] if m[2] else _letters(_col(m[3]) + d_col)
        row = m[5] if m[4] else str(int(m[5]) + d_row)
        return f"{m[2]}{col}{m[4]}{row}"

    return _PIECE.sub(one, formula)


def mangle(formula: str) -> str:
    """Newer functions get the prefix under which files store them."""
    return _PIECE.sub(lambda m: f"_xlfn.{m[7]}" if m[7] and not m[6] and m[7].upper() in MODERN else m[0], formula)


def unmangle(formula: str) -> str:
    return _PIECE.sub(lambda m: m[7] if m[7] and m[6] else m[0], formula)


def translated(formula: Column, d_col: Column, d_row: Column) -> Column:
    @F.pandas_udf("string")
    def udf(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for f, c, r in parts:
            yield pd.Series([None if x is None else translate(x, int(a), int(b)) for x, a, b in zip(f, c, r)])

    return udf(formula, d_col, d_row)


def mangled(formula: Column) -> Column:
    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for f in parts:
            yield pd.Series([None if x is None else mangle(x) for x in f])

    return udf(formula)
