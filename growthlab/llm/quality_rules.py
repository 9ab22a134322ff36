"""Quality rules as a bitmask ledger (operator 8, native).

Every rule is evaluated once per document.  The ledger row holds the measurements and
one failure bit per rule; a policy is a named set of bits, so a new policy version or
an ablation ("what if rule r were off") is bit arithmetic over the ledger and reads
no text.  All expressions are built-in Spark functions on arrays inside the row:
there is no shuffle, so no key can be hot.

Defined cases: a null text counts as empty and has no words; a null id stays null;
repeated rows give repeated ledger rows; an empty table gives an empty ledger; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlab.functions.arrays import let
from growthlab.llm.common import BLANKS, LOWER, UPPER, text_of

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower"]

#: Rule name -> failure condition over the measurements; the position is the bit.
RULES: dict[str, Column] = {}


def _rules() -> dict[str, Column]:
    c = F.col
    return {
        "too_few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbol_density": 100 * c("n_symbols") > 20 * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 20 * c("n_words"),
        "shouting": c("n_upper") > c("n_lower"),
    }


RULE_NAMES = ["too_few_words", "repeated_words", "symbol_density", "repeated_lines", "short_words", "long_words",
              "shouting"]
#: Policies: name and version -> the rules that reject a document.
POLICIES = {
    "base/1": ["too_few_words", "repeated_words"],
    "full/1": RULE_NAMES,
    "full/2": [r for r in RULE_NAMES if r != "short_words"],
}


def mask(rules: list[str]) -> int:
    return sum(1 << RULE_NAMES.index(r) for r in rules)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Windows are sorted with their positions, so equal ones are neighbours; documents
    whose windows are all distinct (a hash-set test) skip the sort."""
    def windows(h):
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

    def neighbours(s):
        return F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"]))
                        | ((i < F.size(s) - 1) & (F.get(s, i + 1)["g"] == x["g"])))

    def covered(g):
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        hits = let(neighbours, s=placed)
        return F.size(F.array_distinct(F.flatten(F.transform(
            hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h):
        return F.when(F.size(h) < 4, F.lit(0)).otherwise(let(
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)),
            g=windows(h)))

    return let(count, h=F.transform(words, lambda w: F.xxhash64(w)))


def measurements(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements as longs), one row per input row."""
    text = text_of(F.col("text"))

    def counted(pattern_free):
        return F.length(text) - F.length(F.translate(text, pattern_free, ""))

    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return docs.select(
        "doc_id", let(of_words, w=words).alias("w"), let(of_lines, lines=lines).alias("l"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        counted(SYMBOLS).cast("long").alias("n_symbols"), counted(UPPER).cast("long").alias("n_upper"),
        counted(LOWER).cast("long").alias("n_lower"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words",
             "n_upper", "n_lower")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_bits``: bit k is set when rule k of RULE_NAMES fails."""
    rules = _rules()
    bits = F.lit(0).cast("long")
    for k, name in enumerate(RULE_NAMES):
        bits = bits.bitwiseOR(F.when(rules[name], F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail nothing else, and that are
    kept once it is switched off.  The ledger is first counted by its failure bits, at
    most one row per bit pattern (2**7), and the rules are read off those patterns."""
    own = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = []
    for name in POLICIES[policy]:
        bit = mask([name])
        fails, alone = F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("bits") == bit
        clean = F.col("bits").bitwiseAND(F.lit(own & ~bit)) == 0
        per_rule.append(F.struct(
            F.lit(name).alias("rule"), *[F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(label) for label, cond in (
                ("n_failed", fails), ("n_failed_alone", alone), ("n_kept_without", clean))]))
    return patterns.agg(F.array(*per_rule).alias("r")).select(F.inline("r"))
