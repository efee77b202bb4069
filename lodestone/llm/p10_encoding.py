"""Problem 10: find and restore text that was decoded with the wrong encoding.

Method: minimum description length.  Every decoding that could undo a wrong one is compressed with a
zstandard dictionary of each language; the chain of decodings with the least compressed size, the cost
of the chain included, is taken, and the text is left as it is where no chain gains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import table

#: Documents (about) of a language whose text its dictionary is made of, and bytes of a dictionary.
SAMPLE, DICTIONARY = 600, 32768
#: Bytes that each link of a chain costs; least gain in bytes; longest chain.
LINK, GAIN, DEPTH = 1, 1, 3
LEVEL = 3


@lru_cache(32)
def _of_byte(encoding: str) -> tuple[str, ...]:
    """The character of each byte; bytes without one are control characters of the same number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(32)
def _to_byte(encoding: str) -> dict[str, int]:
    to = {c: b for b, c in enumerate(_of_byte(encoding)) if b > 127}
    if encoding == "cp1252":  # read as Latin-1 just as often
        to |= {chr(b): b for b in range(128, 256)}
    return to


def _bytes(s: str, encoding: str) -> bytes | None:
    if encoding == "gb18030":
        try:
            return s.encode(encoding)
        except UnicodeEncodeError:
            return None
    to = _to_byte(encoding)
    try:
        return bytes(ord(c) if c < "\x80" else to[c] for c in s)
    except KeyError:
        return None


def _set(chars: str) -> str:
    return "".join(re.escape(c) for c in sorted(set(chars)))


#: First bytes of the UTF-8 sequences of the scripts expected: Latin, Cyrillic; punctuation, CJK, wide forms.
TWO, THREE = (0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xCB, 0xD0, 0xD1), (0xE2, *range(0xE3, 0xEA), 0xEF)


def _chars(encoding: str, codes) -> str:  # noqa: ANN001
    """The characters that stand for these bytes."""
    codes = set(codes)
    return "".join(c for c, b in _to_byte(encoding).items() if b in codes)


@lru_cache(32)
def _utf8_runs(encoding: str) -> re.Pattern[str]:
    """Runs of characters that, as bytes of ``encoding``, are sequences of UTF-8."""
    tail = "[" + _set(_chars(encoding, range(0x80, 0xC0))) + "]"
    return re.compile(f"(?:[{_set(_chars(encoding, TWO))}]{tail}|[{_set(_chars(encoding, THREE))}]{tail}{{2}})+")


def _from_utf8_run(m: re.Match[str], encoding: str) -> str:
    raw = _bytes(m[0], encoding)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def _gbk(first, second) -> str:  # noqa: ANN001
    out = []
    for a in first:
        for b in second:
            try:
                out.append(bytes([a, b]).decode("gbk"))
            except UnicodeDecodeError:
                pass
    return _set("".join(x for x in out if len(x) == 1))


# Decodings are tried where their sign is found, as compressing each line by each chain costs a hundred times
# more.  Signs are wide heuristics, not proofs: what they miss is left as it is.  They are looked for among
# the characters beyond ASCII and the one before and after each run of them.
_LATIN = "A-Za-z"
# four in a row, a word of no other letters, or the leading bytes of two-byte encodings in front of one
_HIGH = "[¡-ÿŒœŠšŸŽžƒˆ˜€™]{4}|(?<![A-Za-z¡-ÿ])[À-ÿ]{2,3}(?![A-Za-z¡-ÿ])|[‚ƒ][\u00a0-ÿŒœŠšŸŽžƒˆ˜€‚-‡‰‹•–—›™]|[\u0080-\u009f]"
_CAPITALS = "[А-ЯЁ]{3}|[а-яё][А-ЯЁ]"
SIGNS = {
    ("cp1252", "cp1251"): _HIGH,
    ("cp1252", "gb18030"): _HIGH,
    ("cp1252", "koi8-r"): _HIGH,
    ("cp1252", "big5"): _HIGH,
    ("cp1252", "cp932"): _HIGH,
    ("cp1252", "mac_roman"): f"[{_LATIN}][ŽŸšŠ‡\u008d\u008f\u008e\u009f\u008a\u009a\u0087][a-z]",
    ("cp1252", "cp850"): f"[{_LATIN}][‚„†‡ˆ‰Š¢£¤¡\u0081][a-z]",
    ("cp1252", "cp437"): f"[{_LATIN}][‚„†‡ˆ‰Š¢£¤¡\u0081][a-z]",
    ("cp1251", "koi8-r"): _CAPITALS,
    ("koi8-r", "cp1251"): _CAPITALS,
    ("cp1251", "cp866"): "[А-Яа-я][Ђ-Џђ-џ€™©®±µ¶]",
    ("cp866", "cp1251"): "[А-Яа-я][─-■]|[─-■][А-Яа-я]",
    ("cp1251", "cp1252"): f"[{_LATIN}][бвгджзийклмнптфцчшщъыьэюя]+[a-z]",
    ("cp850", "cp1252"): f"[{_LATIN}][▀÷³¾ÚÞÝ±ÒþÛ¶]+[a-z]",
    ("cp437", "cp1252"): f"[{_LATIN}][▀÷ⁿΘΦτ±φ≤πσΣ]+[a-z]",
    ("mac_roman", "cp1252"): f"[{_LATIN}][ÈË¸ˆ‰ﬂÒ·ÌÛ„]+[a-z]",
    ("cp1252", "utf-8"): "",
    ("mac_roman", "utf-8"): "",
    ("cp437", "utf-8"): "",
    ("cp850", "utf-8"): "",
    ("cp1250", "utf-8"): "",
    ("cp1253", "utf-8"): "",
    ("cp1254", "utf-8"): "",
    # most letters of these stand for bytes that follow, so a sign needs one that clean text lacks
    ("cp1251", "utf-8"): "[РС][Ђ-Џђ-џ‚„†‡€‰‹•™›¤¦§©¬®°±µ¶·]|[ВГ][Ђ-Џђ-џ©«°±§µ]|вЂ",
    ("koi8-r", "utf-8"): "[пяцбБДЕФГХИО][─-■°²·÷]",
    ("cp866", "utf-8"): "[╨╤├┬][А-Яа-п░▒▓│┤╡╢╖╕╣║╗╝╜╛┐]|[т-щя][А-Я]",
}


@lru_cache(1)
def signs() -> dict[tuple[str, str], re.Pattern[str]]:
    """For each decoding, a pattern without which it changes nothing for the better."""
    out = {k: re.compile(v) if v else _utf8_runs(k[0]) for k, v in SIGNS.items()}
    tail = range(0x80, 0xC0)
    three = f"[{_gbk(range(0xE3, 0xEA), tail)}][{_gbk(tail, (*range(0xE3, 0xEA), 0xEF))}][{_gbk(tail, tail)}]"
    letters = f"[{_LATIN}][{_gbk((0xC3,), tail)}]+[a-z]|[{_gbk((0xC2, 0xC3, 0xE2), tail)}][\ue000-\uf8ff€]|[{_gbk((0xD0, 0xD1), tail)}]{{5}}|[鈥聽聻芦禄掳]"
    out[("gb18030", "utf-8")] = re.compile(f"{three}|{letters}")
    return out


_NOT_ASCII = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")


def view(s: str) -> str:
    """The characters beyond ASCII with one neighbour on either side of a run."""
    return "\x00".join(_NOT_ASCII.findall(s))


@lru_cache(1)
def _any_sign() -> re.Pattern[str]:
    return re.compile("|".join(dict.fromkeys(f"(?:{p.pattern})" for p in signs().values())) + "|[�\x80-\x9f]")


@lru_cache(1)
def _unfit() -> re.Pattern[str]:
    """Signs that keep a line out of the dictionaries: all but words in Cyrillic capitals, which titles have."""
    return re.compile(_any_sign().pattern.replace(f"(?:{_CAPITALS})", "(?:[а-яё][А-ЯЁ])") + "|[\ue000-\uf8ff├┬╨╤╦╬▀]")


def suspicious(text: str) -> bool:
    return not text.isascii() and _any_sign().search(view(text)) is not None


def redo(s: str, read_as: str, really: str) -> str | None:
    """``s`` with one wrong decoding undone, or None where that is not possible or changes nothing."""
    if really == "utf-8" and read_as != "gb18030":
        new = _utf8_runs(read_as).sub(lambda m: _from_utf8_run(m, read_as), s)
        return new if new != s else None
    if read_as == "gb18030" and really == "utf-8":
        # what could not be read is lost, so the rest is taken with marks in its place
        raw = s.replace("�", "\x1a").encode("gb18030", "replace")
        new = raw.decode("utf-8", "replace").replace("\x1a", "�")
        return new if new != s and new.count("�") <= max(2, len(new) // 4) else None
    raw = _bytes(s, read_as)
    if raw is None:
        # characters that the encoding lacks were not read with it: the runs between are undone
        to = _to_byte(read_as)
        parts = re.split("([^\\x00-\\x7f" + _set("".join(to)) + "]+)", s)
        done = [p if i % 2 else redo(p, read_as, really) or p for i, p in enumerate(parts)]
        new = "".join(done)
        return new if new != s else None
    try:
        new = raw.decode(really)
    except UnicodeDecodeError:
        if really not in ("gb18030", "big5", "cp932"):
            table_ = _of_byte(really)
            new = "".join(table_[b] for b in raw)
        else:
            return None
    return new if new != s else None


def redo_words(s: str, read_as: str, really: str) -> str | None:
    """As :func:`redo`, for the words only that show the decoding's sign: parts of a line can be sound."""
    if really == "utf-8" or "[A-Za-z]" not in (sign := signs()[(read_as, really)]).pattern:
        return None
    new = re.sub(r"\S+", lambda m: (redo(m[0], read_as, really) or m[0]) if sign.search(m[0]) else m[0], s)
    return new if new != s else None


class Languages:
    """Compressors with one dictionary for each language."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.compressors = [z.ZstdCompressor(dict_data=self._ready(z, d), compression_params=p) for _, d in sorted(dictionaries.items())]

    @staticmethod
    def _ready(z, data: bytes):  # noqa: ANN001, ANN205
        d = z.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return d

    def size(self, s: str) -> int:
        raw = s.encode("utf-8", "replace")
        return min(len(c.compress(raw)) for c in self.compressors)


def train(texts: dict[str, list[str]]) -> dict[str, bytes]:
    """A zstandard dictionary for each language with enough text."""
    import zstandard as z

    out = {}
    for lang, rows in sorted(texts.items()):
        samples = [p.encode("utf-8", "replace") for t in rows for p in t.split("\n") if p.strip()]
        if sum(map(len, samples)) < 4096 or len(samples) < 8:
            continue
        try:
            out[lang] = z.train_dictionary(min(DICTIONARY, sum(map(len, samples)) // 2), samples).as_bytes()
        except z.ZstdError:
            out[lang] = b"".join(samples)[-DICTIONARY:]
    return out or {"": b" " * 64}


def _price(old: str, new: str, pair: tuple[str, str]) -> int:
    """What the use of a link costs: itself, the runs that it leaves out, and the characters that it loses."""
    lost = 4 * max(0, new.count("�") - old.count("�"))
    if pair[1] == "utf-8" and pair[0] != "gb18030":
        rest = re.sub(r"[\x00-\x7f]+", " ", _utf8_runs(pair[0]).sub(" ", old))
        return LINK + lost + len(rest.replace(" ", ""))
    return LINK + lost


def best_chain(s: str, langs: Languages) -> tuple[str, tuple[str, ...]]:
    """The restored string and its chain of ``read as>really`` links; (s, ()) where none gains."""
    pats = signs()
    first = langs.size(s)
    best, front, seen = (first, s, ()), [(s, (), 0)], {s}
    for _ in range(DEPTH):
        ahead = []
        for cur, chain, paid in front:
            seen_of = view(cur)
            for pair, sign in pats.items():
                if not sign.search(seen_of):
                    continue
                for new in (redo(cur, *pair), redo_words(cur, *pair)):
                    if new is None or new in seen:
                        continue
                    seen.add(new)
                    price = paid + _price(cur, new, pair)
                    size = langs.size(new) + price
                    link = (*chain, f"{pair[0]}>{pair[1]}")
                    ahead.append((size, new, link, price))
                    if size < best[0] and size <= first - GAIN:
                        best = (size, new, link)
        ahead.sort(key=lambda x: x[0])
        front = [(n, c, p) for _, n, c, p in ahead[:3]]
    return best[1], best[2]


def restore(text: str, langs: Languages) -> tuple[str, tuple[str, ...], bool]:
    """(restored text, chains used, garbled) of a whole text, line by line.

    A text without any sign of a wrong decoding, empty ones among them, is returned as it is.  A line
    is garbled if a chain gains on it, or if it holds a replacement character (what was lost cannot be
    restored) or a control character of the upper half.
    """
    if not suspicious(text):
        return text, (), False
    lines, chains, garbled = text.split("\n"), set(), False
    for i, line in enumerate(lines):
        if line.isascii():
            continue
        if suspicious(line):
            new, chain = best_chain(line, langs)
            if chain:
                lines[i], garbled = new, True
                chains.add("|".join(chain))
        garbled = garbled or any(c == "�" or "\x80" <= c <= "\x9f" and c != "\x85" for c in line)
    for i, line in enumerate(lines if chains else ()):  # short lines take a chain of the others where it costs nothing
        if not line.isascii() and suspicious(line):
            for chain in sorted(chains):
                new: str | None = line
                for link in chain.split("|"):
                    new = redo(new, *link.split(">")) if new is not None else None
                if new is not None and "�" not in new and langs.size(new) <= langs.size(line):
                    lines[i] = new
                    break
    return "\n".join(lines), tuple(sorted(chains)), garbled


def dictionaries(df: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE) -> dict[str, bytes]:
    """Dictionaries from about ``sample`` rows of each language, drawn by the hash of their key.

    The one bounded step: the draw is brought to the driver and does not grow with the table.
    """
    of = F.lower(F.substring(lang, 1, 2))
    has = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) < 20_000)).withColumn("_l", of)
    counts = {r[0]: r[1] for r in has.groupBy("_l").count().orderBy(F.desc("count")).limit(50).collect()}
    if not counts:
        return train({})
    part = F.lit(0)
    for k, n in counts.items():
        part = F.when(F.col("_l") == k, F.lit(max(1, round(min(1.0, sample / n) * 1_000_000)))).otherwise(part)
    drawn = has.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < part)
    texts: dict[str, list[str]] = {}
    for a, t in drawn.select("_l", F.col(text)).limit(2 * sample * len(counts)).collect():
        # garbled lines in a dictionary would make their like cheap
        texts.setdefault(a, []).append("\n".join(x for x in t.split("\n") if x.isascii() or not _unfit().search(view(x))))
    return train(texts)


def restored(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """key, restored text and chains of the rows whose text is garbled, wholly or in part, restorable or not.

    Null texts and keys give no rows; repeated rows come out as often as they occur.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries(df, text, lang, key))  # at most DICTIONARY bytes a language
    rows = df.select(key, F.col(text).alias("_t")).where(F.col(key).isNotNull() & F.col("_t").rlike("[^\\x00-\\x7F]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = None
        for b in batches:
            at, new, chains = [], [], []
            for i, t in enumerate(b.column("_t").to_pylist()):
                if not suspicious(t):
                    continue
                langs = langs or Languages(shared.value)
                r, c, g = restore(t, langs)
                if g:
                    at.append(i)
                    new.append(r)
                    chains.append(list(c))
            keys = b.column(key).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(new, pa.string()), pa.array(chains, pa.list_(pa.string()))], names=[key, "restored", "chains"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, restored string, chains array<string>")


def p10_restored(spark: SparkSession, root: str) -> DataFrame:
    """Garbled documents with their restored text."""
    return restored(table(spark, root, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Garbled documents."""
    return p10_restored(spark, root).select("doc_id").distinct()


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
ORACLE: dict[str, str] = {}
