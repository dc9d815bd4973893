"""Fixed values.

These must equal the values of the rule set we reproduce, or results differ.
They are stated here once, as plain text, in their natural order; every
other module imports them from here.
"""

# Fixed values ---------------------------------------------------------------

# Characters the special-character cleaner deletes from a formula.
STRIP_CHARS = "-:;!?\"'`´"

# Quoted spans listed by the quote diagnostic: "...", `...`, ´...´, '...'.
QUOTED_SPAN_PATTERN = "\"[^\"]*\"|`[^`]*`|´[^´]*´|'[^']*'"

# A whitespace token counts as punctuated if it holds one of these.
PUNCTUATION_CLASS = "[-:;!?]"

# Adverbs of time, duration and frequency.
TIME_ADVERBS = ("now", "today", "yesterday", "tomorrow", "later", "soon", "recently")
DURATION_ADVERBS = ("forever", "briefly", "permanently", "temporarily")
FREQUENCY_ADVERBS = ("often", "usually", "sometimes", "rarely", "occasionally")

# Whole-word rules: a word before "(" (deleted when finding constants) and a
# function name (a word followed by "("). Spark adds the (?U) flag.
WORD_BEFORE_PAREN = r"\b\w+\s*\("
NAME_BEFORE_PAREN = r"\b\w+(?=\s*\()"

# Error-category labels, in catalogue order.
CATEGORY_LABELS = (
    "missing_category",
    "overgeneralization",
    "wrong_variable_binding",
    "free_variable_error",
    "biconditional_instead_implication",
    "conjunction_instead_implication",
    "invalid_xor_usage",
    "missing_parentheses",
    "global_negation_error",
    "missing_condition_negation",
    "wrong_negation_scope",
    "neither_nor_translation_error",
    "predicate_naming_error",
)
# The single-category design adds this category (no prefilter).
PREDICATE_NESTING = "predicate_nesting_error"

# Candidate predicates: one-letter lowercase word; the word "neither" in the sentence.
ONE_LETTER_WORD = r"\b[a-z]\b"
NEITHER_WORD = r"(?i)\bneither\b"

# The two allowed answers of a single-category check, and the multi-label "nothing applies".
ANSWER_APPLIES = "error category does apply"
ANSWER_NOT_APPLIES = "error category does not apply"
NO_LABEL = "none"

# Prompt layouts: field labels, their order and line breaks. {sentence} and
# {formula} are the row's pair; the other fields come from the catalogue.
FEW_SHOT_LAYOUT = (
    "Sentence: {sentence}\n"
    "Incorrect Translation: {wrong}\n"
    "Correct Translation: {right}\n"
    "Error category: {label}\n\n"
)
CATEGORY_LINE_LAYOUT = "- {label}: {description}"
ROW_LAYOUT_CATALOGUE = "Sentence: {sentence}\nTranslation: {formula}\n\n"
CATEGORY_BLOCK_LAYOUT = (
    "Error label: {label}\n"
    "Instruction: {instruction}\n"
    "Positive example (correct):\n"
    "  Sentence: {positive_sentence}\n"
    "  Formula: {positive_formula}\n"
    "Negative example (error):\n"
    "  Sentence: {negative_sentence}\n"
    "  Formula: {negative_formula}\n"
)
BLOCK_EXPLANATION_LAYOUT = "  Explanation: {explanation}\n"
ROW_LAYOUT_PAIRED = "------------------------------\nSentence:\n{sentence}\n\nFormula:\n{formula}\n\n"
SINGLE_EXAMPLE_LAYOUT = "Sentence: {sentence}\nFOL: {formula}\nAnswer: {answer}\n\n"
ROW_LAYOUT_SINGLE = "Example:\nSentence: {sentence}\nFOL: {formula}\nAnswer:"
CORRECTION_EXAMPLE_LAYOUT = (
    "Example {number}:\n"
    "Sentence: {sentence}\n"
    "Translation: {wrong}\n"
    "Corrected Translation: {right}\n"
)
CORRECTION_EXPLANATION_LAYOUT = "Explanation: {explanation}\n"
ROW_LAYOUT_CORRECTION = "Example {number}:\nSentence: {sentence}\nTranslation: {formula}\nCorrected Translation:"

# Sampling seeds: designs 1 and 2, design 3.
SEED_MULTI = 3
SEED_SINGLE = 42

# Model settings.
TEMPERATURE = 0.0
MAX_RETRIES = 2
