"""Per-document text statistics and text types from thresholds as noisy labellers.

Statistics of a text are sums over its lines. Thresholds on the statistics of a line are
labelling functions that vote for its type (prose, list, table, junk) or abstain; each reads
another property: known words, end, length, bullets, cells, digits, symbols, word lengths,
repetition, and one a decision rule over several. How often each is right is not told but
learned: expectation-maximization over the vote patterns of all lines of all documents, whose
characters Spark adds up, fits for every labeller the distribution of its votes given the
type. A document's posterior is that of its lines' patterns, weighted by characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("prose", "list", "table", "junk")

#: Frequent function words of the languages that are told apart.
COMMON = {
    "en": "the of and to a in is that it was for on are as with his they i at be this have from or had by not but what all were we when your can said there an each which she do how their if will up other about out many then them these so some her would him has two more no could my than been who its now did get made after back only years where most before because too any same also very while one our even as up again twice although later until us whose whenever beside every between while near only if".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich wir warum niemand muss immer keine diese dieser sondern wer den".split(),
    "fr": "le la les de des du un une et à en est que qui dans ce il pas pour sur au avec ne se par plus ou son mais nous ont été cette était on sa ses leur elle y comme si tout aux d l n c s qu a sans avant encore où quand pourquoi personne je vous avons".split(),
    "es": "el la los las de que y a en un una ser se no por con su para como estar tener le lo todo pero más o este ya está era del al sus muy sin sobre me hay donde quien desde nos durante uno ni contra ese eso había antes cuando nadie porque qué quién ha han fue es después todavía aunque mi sino ella él".split(),
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у который то за свой от со для о же так вы все его как только или ещё бы был до если чтобы когда нет тот мой через никто всё снова об под чем уже было была были где кто этом".split(),
    "el": "και το να του η της με που την από για τα είναι των σε ο οι στο θα τη στην τον τους δεν τις ένα μια ότι ή στα αυτό κι αν μου στον όταν πριν μετά ήταν κανείς δε πως αλλά γιατί ακόμα μας τι ποιος στις στη ενώ όμως".split(),
}
ANY_COMMON = frozenset(w for ws in COMMON.values() for w in ws if len(w) > 1 or w in "aàyoивскуяηο")

WORD = regex.compile(r"[\p{L}\p{M}]+")
BULLET = regex.compile(r"\s*(?:[-*•·‣▪◦●○■□–—+>»→✓✔☐☑]\s|\[[ xX]?\]|\(?\p{L}?\d{0,4}[.)\]:]\s|\(\p{L}\)\s|№\s*\d)")
SENTENCE_END = regex.compile(r"[.!?…。！？；;·।॥؟۔።]+[\"'”’»«“)」』\]]*\s*$")
CELLS = regex.compile(r"\t|\|\||\||;|,|·|:")
KANA = regex.compile(r"[ぁ-ゟ]")
EAST = regex.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
STOP = regex.compile(r"[.!?。！？।؟۔።]+\s*")
#: Letters of scripts without a list of words, by exclusion of those that have one.
UNLISTED = regex.compile(r"(?![\p{Latin}\p{Cyrillic}\p{Greek}\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}]")
SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\s]")
DIGIT = regex.compile(r"\p{N}")
#: Columns of the statistics. Words are runs of letters and marks: numbers are none, and a run of
#: script without spaces is one. punct_line_share counts the lines of the text that are not blank;
#: ended_share and the shares of kinds are over characters of joined lines.
STATS = ("word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_line_share", "common_share", "prose_share", "list_share", "table_share", "junk_share", "short_share", "repeat_share", "ended_share")


def joined_lines(text: str) -> list[str]:
    """Lines of a text; a line that goes on in lower case belongs to the one before."""
    out: list[str] = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            continue
        if out and bare[0].islower() and out[-1].count("|") < 2 and not SENTENCE_END.search(out[-1]) and not CELLS.search(bare[:24]):
            out[-1] += " " + bare
        else:
            out.append(bare)
    return out


def unlisted_prose(line: str, symbols: int, digits: int) -> bool:
    """Whether a line in a script without a list of words reads as a sentence: long, ended,
    nearly only letters, and neither one word again and again nor a row of cells."""
    n = len(line)
    if line.isascii() or n < 12 or SENTENCE_END.search(line) is None or symbols > 0.12 * n or digits > 0.15 * n:
        return False
    if len(UNLISTED.findall(line)) < 0.5 * (n - line.count(" ")) or line.count("|") or "\t" in line:
        return False
    words = WORD.findall(line)
    return len(set(words)) >= 0.5 * min(len(words), 30) and len(set(line)) >= 8


def line_kind(line: str, words: list[str], symbols: int, digits: int) -> str:
    """prose, list, table, junk or short (a line of a menu, a heading, an item)."""
    n = len(line)
    east = len(EAST.findall(line)) if not line.isascii() else 0
    bullet = BULLET.match(line) is not None
    if east >= 4 and east >= 0.3 * (n - digits):
        if not bullet and east >= 10 and digits <= 0.2 * n and len(KANA.findall(line)) >= 0.3 * east:
            return "prose"
        if bullet:
            return "list"
        # sentences without kana; items and headings have no full stop
        ended = regex.search(r"[。！？][”’」』）]*$", line) is not None
        if ended and east >= 8 and digits <= 0.15 * n and symbols <= 0.2 * n and len(set(line)) >= 0.4 * min(n, 30):
            return "prose"
        return "table" if len(CELLS.findall(line)) >= 2 or digits > 0.3 * n else "short" if n < 16 else "list"
    distinct = len(set(words))
    common = sum(w in ANY_COMMON for w in words)
    ended = SENTENCE_END.search(line) is not None
    if len(words) >= (8 if bullet else 4) and line.count("|") < 3 and symbols <= 0.2 * n and digits <= 0.3 * n:
        if common >= (0.14 if ended else 0.2) * len(words) and common >= 1 + (len(words) > 5) and distinct >= 0.4 * min(len(words), 20):
            return "prose"
    if bullet:
        return "list"
    if unlisted_prose(line, symbols, digits):
        return "prose"
    if len(words) >= 6 and distinct <= 0.3 * min(len(words), 30):
        return "junk"
    cells = len(CELLS.findall(line))
    if cells >= 2 and (digits >= 0.1 * n or cells >= 0.3 * len(words)):
        return "table" if symbols <= 0.3 * n else "junk"
    if len(words) <= 4 and n <= 48 and symbols <= 0.2 * n:
        return "list" if digits else "short"
    if digits == 0 and symbols <= 0.1 * n and cells >= 2 and distinct >= 0.8 * len(words):
        return "short"
    return "junk"


def statistics(text: str, patterns: dict[str, int] | None = None) -> tuple[float, ...] | None:
    """The STATS of a text; None if it is null or blank. patterns: takes the characters of
    its lines by their votes."""
    lines = joined_lines(text or "")
    if not lines:
        return None
    share = dict.fromkeys("pltj", 0)
    short = total = words_n = letters = symbols_n = digits_n = ended = common = 0
    seen: dict[str, int] = {}
    for line in lines:
        n = len(line)
        words = WORD.findall(line.lower())
        symbols, digits = len(SYMBOL.findall(line)), len(DIGIT.findall(line))
        cast = votes(line, words, symbols, digits)
        if patterns is not None:
            patterns[cast] = patterns.get(cast, 0) + n
        share[cast[0]] += n
        short += n if len(words) <= 4 and n <= 48 else 0
        total += n
        words_n += len(words)
        letters += sum(map(len, words))
        symbols_n += symbols
        digits_n += digits
        common += sum(w in ANY_COMMON for w in words)
        if SENTENCE_END.search(line):
            ended += n
        for sentence in STOP.split(line):
            if len(sentence) > 3:
                seen[sentence] = seen.get(sentence, 0) + 1
    spoken = sum(len(k) * v for k, v in seen.items())
    again = sum(len(k) * (v - 1) for k, v in seen.items())
    solid = max(1, sum(len(s) - s.count(" ") for s in lines))
    physical = [line for line in text.splitlines() if line.strip()]
    punctuated = sum(SENTENCE_END.search(line) is not None for line in physical)
    return (
        float(words_n), letters / max(1, words_n), symbols_n / solid, digits_n / solid, punctuated / len(physical), common / max(1, words_n),
        share["p"] / total, share["l"] / total, share["t"] / total, share["j"] / total, short / total, again / max(1, spoken), ended / total,
    )


def votes(line: str, words: list[str], symbols: int, digits: int) -> str:
    """One letter for each labelling function: p, l, t, j for a type, - for no vote."""
    n, many = len(line), len(words)
    common = sum(w in ANY_COMMON for w in words)
    east = 0 if line.isascii() else len(EAST.findall(line))
    listed = east < 0.3 * n and (line.isascii() or len(UNLISTED.findall(line)) < 0.3 * n)
    # a semicolon asks in Greek and ends statements of programs in ASCII
    ended = SENTENCE_END.search(line) is not None and not (line.isascii() and line.endswith(";"))
    cells = len(CELLS.findall(line))
    distinct = len(set(words))
    length = sum(map(len, words)) / many if many else 0.0
    width = n + east  # characters without spaces between words are worth two
    rule = line_kind(line, words, symbols, digits)
    return "".join((
        "l" if rule == "short" else rule[0],
        "-" if not listed or many < 4 else "p" if common >= 0.2 * many and common > 1 else "j" if common == 0 and many >= 6 else "-",
        "p" if ended and (many >= 5 or east >= 10) else "l" if not ended and many <= 4 and east < 10 else "-",
        "l" if BULLET.match(line) else "-",
        "t" if line.count("|") > 1 or "\t" in line or (cells >= 2 and cells >= 0.3 * many and digits) else "-",
        "t" if digits > 0.3 * n and symbols <= 0.3 * n else "p" if digits <= 0.05 * n and width >= 40 else "-",
        "j" if symbols > 0.3 * n else "p" if symbols <= 0.08 * n and width >= 40 else "-",
        "j" if many and listed and not 2 <= length <= 14 else "-",
        "j" if many >= 8 and distinct <= 0.3 * min(many, 40) else "-",
        "p" if many >= 8 and many >= 2.5 * (cells + 1) or width >= 40 and east and cells < 3 else "l" if width < 24 else "-",
    ))


LETTERS = "pltj-"


def posteriors(counts: dict[str, int], rounds: int = 30) -> dict[str, np.ndarray]:
    """Posterior over TYPES of each vote pattern, by expectation-maximization.

    counts: characters of lines by pattern. Every labeller that votes has, given the type, a
    distribution of its votes; it starts at mostly right and keeps that as a weak prior.
    What a labeller does not vote on is left out.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[LETTERS.index(c) for c in p] for p in patterns])
    start = np.full((len(TYPES), len(TYPES)), 0.1)
    np.fill_diagonal(start, 0.7)
    table = np.repeat(start[None], v.shape[1], 0)
    prior = np.full(len(TYPES), 1 / len(TYPES))
    weight = 0.02 * n.sum() + 1
    for _ in range(rounds):
        likely = np.concatenate([np.log(table), np.zeros((*table.shape[:2], 1))], 2)  # silence says nothing
        log = np.log(prior) + sum(likely[k][:, v[:, k]].T for k in range(v.shape[1]))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        prior = (post * n[:, None]).sum(0) + 1
        prior /= prior.sum()
        for k in range(v.shape[1]):
            got = np.stack([(post * n[:, None] * (v[:, k] == c)[:, None]).sum(0) for c in range(len(TYPES))], 1)
            table[k] = got + weight * start
            table[k] /= table[k].sum(1, keepdims=True)
    return dict(zip(patterns, post, strict=True))


def text_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, STATS..., votes): statistics are null for null and blank texts, votes are
    the characters of a text's lines by vote pattern."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cast = [], []
            for t in batch.column(1):
                patterns: dict[str, int] = {}
                rows.append(statistics(t.as_py(), patterns))
                cast.append(list(patterns.items()) if patterns else None)
            columns = [pa.array([None if r is None else r[k] for r in rows], pa.float64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(cast, pa.map_(pa.string(), pa.int64()))], ["doc", *STATS, "votes"])

    fields = ", ".join(f"{s} double" for s in STATS)
    out = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).mapInArrow(run, f"doc {kind}, {fields}, votes map<string,bigint>")
    return out.withColumnRenamed("doc", doc_id)


def text_types(stats: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, p_prose, p_list, p_table, p_junk) of the rows of text_statistics with votes:
    the posterior types of their characters.

    There are fewer than 4 ** 10 patterns and in practice hundreds, so their counts fit the
    driver; they come from all lines of all documents. Documents are told apart by doc_id.
    """
    lines = stats.where("votes is not null").select(doc_id, F.explode("votes").alias("pattern", "characters"))
    counts = {r[0]: r[1] for r in lines.groupBy("pattern").agg(F.sum("characters")).collect()}
    found = {p: [float(x) for x in post] for p, post in posteriors(counts).items()}
    shared = stats.sparkSession.createDataFrame([(p, *post) for p, post in found.items()], "pattern string, " + ", ".join(f"p_{t} double" for t in TYPES))
    weighted = [(F.sum(F.col("characters") * F.col(f"p_{t}")) / F.sum("characters")).alias(f"p_{t}") for t in TYPES]
    return lines.join(F.broadcast(shared), "pattern").groupBy(doc_id).agg(*weighted)  # hundreds of patterns
