"""String column functions.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as Go's unicode.IsSpace sees it: TAB, LF,
# VT, FF, CR, space, U+0085, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000. The Java regex class \s under (?U) is the same set.
UNICODE_SPACES = ("\t\n\x0b\x0c\r \x85\xa0\u1680"
                  + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000")
_ANY_SPACE_RUN = r"(?U)\s+"
# Characters removed inside codes and names: ASCII space and ideographic space.
_INNER_SPACES = " 　"
# Characters a file name may not hold; each becomes "_".
_UNSAFE_FILE_CHARS = '/\\:*?"<>| '


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c) -> Column:
    """Strip leading/trailing Unicode white space (plain ``trim`` strips
    only the ASCII space); ``btrim`` over the fixed set, no regex. Texts that begin
    and end with a printable ASCII character or one past U+3000, the last white
    space, are spared it."""
    c = _c(c)

    def plain(at: Column) -> Column:  # texts compare by their first bytes
        return ((at >= F.lit("!")) & (at < F.lit("\x7f"))) | (at >= F.lit("\u3001"))
    return F.when(plain(c) & plain(F.right(c, F.lit(1))), c).otherwise(F.btrim(c, F.lit(UNICODE_SPACES)))


def normalize_code(c) -> Column:
    """S1, then delete every ASCII space and U+3000 inside the value."""
    return F.translate(trim_unicode(c), _INNER_SPACES, "")


def blank_to_default(c, default: str) -> Column:
    """I7: '' (or NULL) becomes ``default``."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def pack_texts(cols: list) -> Column:
    """Several texts (NULLs too) as one: a row that is shuffled with one text takes much less room than with many."""
    return F.to_json(F.array(*[_c(c) for c in cols]))


def unpack_texts(packed) -> Column:
    """The texts of ``pack_texts`` as an array, exactly; of any length."""
    return F.from_json(_c(packed), "array<string>", {"mode": "FAILFAST", "maxStringLen": str(2 ** 31 - 1)})


def clean_text(c) -> Column:
    """newline/CR/tab to space, trim, collapse white-space runs to one space."""
    return trim_unicode(F.regexp_replace(_c(c), _ANY_SPACE_RUN, " "))


def safe_file_name(c) -> Column:
    """E9 ``sanitize``: trim, unsafe characters to '_', empty becomes 'unknown'."""
    out = F.translate(trim_unicode(c), _UNSAFE_FILE_CHARS, "_" * len(_UNSAFE_FILE_CHARS))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


def like_pattern(q: str) -> str:
    """``%q%`` with PostgreSQL LIKE escapes made acceptable to Spark.

    PostgreSQL reads ``\\a`` as a literal ``a``; Spark rejects it. A backslash is
    therefore kept only before ``%``, ``_`` or another backslash.
    """
    out, i = [], 0
    while i < len(q):
        ch = q[i]
        if ch == "\\":
            if i + 1 >= len(q):
                raise ValueError("LIKE pattern must not end with escape character")
            nxt = q[i + 1]
            out.append("\\" + nxt if nxt in "%_\\" else nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def like_search(code_col, name_col, q: str) -> Column:
    """Case-sensitive ``code LIKE %q% OR name LIKE %q%``; q's own % and _ act as wildcards."""
    p = like_pattern(q)
    return _c(code_col).like(p) | _c(name_col).like(p)
