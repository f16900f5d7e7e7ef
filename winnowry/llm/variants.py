"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters, so a letter added, removed or
exchanged changes it by that letter's power or by the difference of two.  Words one letter apart are
therefore found by joins of keys: a key less the value of one letter equals the key of the word without that
letter, and two words that differ by an exchange have equal keys once each has lost the letter that the other lacks.

Keys know nothing of the order of letters.  Of two words one letter apart either the first half or the rest is the
same, so the joins ask for one equal half as well, and the letter in question lies in the other half: anagrams do not
meet in masses.  What meets is verified on the letters in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, is_empty

LETTERS = "a-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are kept below this prime, so that no word is too long for them.
_PRIME = (1 << 61) - 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, typo_every: int | None = None) -> DataFrame:
    """Rows (word, n): runs of letters of ``least_letters`` or more, A-Z as a-z, and how often they occur.

    With ``typo_every`` about one run in so many loses a letter, as a hash of id and run says: known typing errors to
    measure by.  Counts are summed before the shuffle.

    Defined cases: null and empty texts have no words; a null id is the empty id; repeated rows count each; no rows give no rows.
    """
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    if typo_every is None:
        return docs.select(F.explode(runs).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    ident = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    each = docs.select(ident.alias("ident"), F.explode(runs).alias("run"))
    each = each.select("run", F.crc32(F.concat("ident", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % typo_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))


def _letters(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.ascii(F.substring(word, i, F.lit(1))).cast("long"))


def _value(letter: Column) -> Column:
    return letter * letter * letter * letter * letter


def with_keys(words: DataFrame) -> DataFrame:
    """Adds size, letters (their numbers in order) and key."""
    out = words.withColumn("size", F.char_length("word")).withColumn("letters", _letters(F.col("word")))
    key = F.aggregate("letters", F.lit(0).cast("long"), lambda s, x: (s + _value(x)) % _PRIME)
    return out.withColumn("key", key)


def _without(first: Column, n: Column) -> Column:
    """Keys without one of the letters from place ``first`` (from 1) on, ``n`` of them."""
    return F.array_distinct(F.transform(F.slice("letters", first, n), lambda x: F.pmod(F.col("key") - _value(x), F.lit(_PRIME))))


def near_words(keyed: DataFrame) -> DataFrame:
    """Rows (word, near, near_n) for every two words one letter apart, both ways; ``keyed`` has word, n, size, letters, key.

    A side is 0 where the beginnings have to be equal, 1 where the ends have.

    The joins are told to sort: Spark sizes a table before its rows are exploded, a row a letter here, so it would send
    rows of many times its limit to the driver.
    """
    size = F.col("size")
    left = lambda n: F.substring("word", F.lit(1), n)
    right = lambda n: F.substring("word", size - n + 1, n)

    def rows(part: list[tuple[Column, Column]], length: Column) -> DataFrame:
        """One row for each side and key: (side, half, keys)."""
        sides = F.array(*[F.struct(F.lit(i).alias("side"), half.alias("half"), keys.alias("keys")) for i, (half, keys) in enumerate(part)])
        each = keyed.select("word", "n", length.alias("size"), F.explode(sides).alias("s"))
        return each.select("word", "n", "size", "s.side", "s.half", F.explode("s.keys").alias("key"))

    # exchange: both words lose one letter of the half that may differ
    m = F.floor(size / 2).cast("int")
    lost = rows([(left(m), _without(m + 1, size - m)), (right(size - m), _without(F.lit(1), m))], size)
    # the longer word of an addition loses one letter and has the shorter one's key
    m1 = F.floor((size - 1) / 2).cast("int")
    longer = rows([(left(m1), _without(m1 + 1, size - m1)), (right(size - 1 - m1), _without(F.lit(1), m1 + 1))], size - 1)
    shorter = rows([(left(m), F.array("key")), (right(size - m), F.array("key"))], size)

    on = ["key", "size", "side", "half"]
    other = lambda t: t.select(*on, F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge")
    one_apart = F.levenshtein("word", "near", 1) == 1
    exchanged = lost.join(other(lost), on).where((F.col("word") != F.col("near")) & one_apart).select("word", "near", "near_n")
    # a letter added in the middle leaves both halves equal; such a pair is taken from the first side
    m2 = F.floor((F.char_length("word") - 1) / 2).cast("int")
    once = (F.col("side") == 0) | (F.substring("word", F.lit(1), m2) != F.substring("near", F.lit(1), m2))
    added = longer.join(other(shorter), on).where(once & one_apart).select("word", "n", "near", "near_n")
    back = added.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return exchanged.unionByName(added.drop("n")).unionByName(back)


def roots(forms: DataFrame, store: Scratch) -> DataFrame:
    """Rows (word, root): the last of word, form, the form's form and so on; ``forms`` has rows (word, form) without circles.

    Each round doubles the steps that are taken at once.  Words compress well, so the size of a stored table says too
    little about what a broadcast of it would need.
    """
    cur = store.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        if is_empty(cur.join(ahead, "root", "left_semi")):
            return cur
        step = cur.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        new = store.keep(step, "roots")
        store.drop(cur)
        cur = new


def group_variants(words: DataFrame, store: Scratch, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of the words that occur ``least_count`` times or more.

    Two words are near if one letter is inserted, deleted or replaced.  A word's form is its near word of largest
    n, of equals the first in code-point order, if that n is ``ratio`` times its own or more, else null; the root is where forms lead, and the word itself without a form.

    Defined cases: ``words`` has each word once; a word near no other has n_near 0; no rows give no rows.
    """
    keyed = store.keep(with_keys(words.where(F.col("n") >= least_count)), "words")
    best = near_words(keyed).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    good = -F.col("b.less") >= F.col("n") * ratio
    out = keyed.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")
    )
    out = store.keep(out, "forms")
    ends = roots(out.where("form IS NOT NULL"), store)
    return out.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    typo_every: int | None = None,
) -> DataFrame:
    """The words of all documents with their forms and roots; see ``word_counts`` and ``group_variants``, also for the defined cases."""
    return group_variants(word_counts(docs, id_col, text_col, least_letters, typo_every), Scratch(docs.sparkSession, "variants"), least_count, ratio)


#: DuckDB SQL of the query; crc32 is stepped byte by byte over a table made by its rule, near words meet by deleted places.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hx AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM per),
octets AS (SELECT *, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM hx),
crc AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM octets, tab),
made AS (SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM crc),
w AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
del AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM del),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM pairs GROUP BY word),
form AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n,
         CASE WHEN b.m >= 5 * w.n THEN (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.m) END AS form
  FROM w LEFT JOIN best b ON w.word = b.word),
up AS (
  SELECT word, word AS at, form FROM form
  UNION ALL SELECT up.word, f.word, f.form FROM up JOIN form f ON up.form = f.word)
SELECT f.word, f.form, u.at AS root, f.n, f.n_near, f.form_n FROM form f JOIN up u ON f.word = u.word AND u.form IS NULL
"""
