"""Values that must match what other tools expect, kept as plain text.

Everything in this file is a FIXED VALUE (format marker, wording, pattern,
constant), not logic.  Changing one changes results.
"""

# Label positions that do not count towards a loss.
IGNORE_LABEL = -100

# Score of a rejected / chosen answer in log space (flow-balance reward).
REJECTED_SCORE = -8.0
CHOSEN_SCORE = 0.0

# Chat markers.
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>"
CHATML_CUE = "<|im_start|>assistant\n"
INST_OPEN = "[INST]"
INST_CLOSE = "[/INST]"
LLAMA_BOS = "<s>"
LLAMA_EOS = "</s>"

# Verdict patterns, by task; group 2 is the verdict letter.
VERDICT_PATTERN = {
    "tldr": r"(?i)(preferred): (.)",
    "hh": r"(?i)(more helpful): (.)",
}

# Up to and including the last sentence mark.
SENTENCE_PREFIX = r"(?s)^(.*[.!?])"

# Default tokenizer: a chat marker, a run without blanks, or a lone "<".
TOKEN_PATTERN = r"<\|[a-z_]+\|>|[^ \t\n\r\f<]+|<"

# Floor of the norm when a vector is normalized.
NORM_FLOOR = 1e-12

# Judge wording, by (task, mode): text before the query, before answer A,
# before answer B, and after answer B.
JUDGE_WORDING = {
    ("hh", None): (
        "For the following query to a chatbot, which response is more helpful?\n\nQuery:\n",
        "\n\nResponse A: ",
        "\n\nResponse B: ",
        "\n\nFIRST provide a one-sentence comparison of the two responses and explain "
        'which you feel is more helpful. SECOND, on a new line, state only "A" or "B" '
        "to indicate which response is more helpful. Your response should use the format:"
        "Comparison: <one-sentence comparison and explanation>\n"
        'More helpful: <"A" or "B">',
    ),
    ("tldr", "concise"): (
        "Which of the following summaries does a better job of summarizing the most "
        "important points in the given forum post, without including unimportant or "
        "irrelevant details? A good summary is both precise and concise.\n\nPost:\n",
        "\n\nSummary A: ",
        "\n\nSummary B: ",
        "\n\nFIRST provide a one-sentence comparison of the two summaries, explaining which "
        'you prefer and why. SECOND, on a new line, state only "A" or "B" to indicate your '
        "choice. Your response should use the format:\n"
        "Comparison: <one-sentence comparison and explanation>\n"
        'Preferred: <"A" or "B">',
    ),
    ("tldr", "simple"): (
        "Which of the following summaries does a better job of summarizing the most "
        "important points in the given forum post?\n\nPost:\n",
        "\n\nSummary A: ",
        "\n\nSummary B: ",
        "\n\nFIRST provide a one-sentence comparison of the two summaries, explaining which "
        'you prefer and why. SECOND, on a new line, state only "A" or "B" to indicate your '
        "choice. Your response should use the format:\n"
        "Comparison: <one-sentence comparison and explanation>\n"
        'Preferred: <"A" or "B">',
    ),
}

# Corpus splits: task -> (train, evaluation of pairs, evaluation of prompts).
SPLITS = {
    "hh": ("train", "test", "test"),
    "tldr": ("train", "valid1", "test"),
}
