"""Declared schemas; no reader in this package infers one."""

MESSAGES = "array<struct<role:string,content:string>>"

HH_RAW = (
    "row_idx bigint, split string, context array<struct<role:string,text:string>>, "
    "chosen struct<text:string>, rejected struct<text:string>"
)
TLDR_RAW = "row_idx bigint, split string, prompt string, chosen string, rejected string"

# One line per prompt.  A prompt whose lists are longer than a line may hold
# continues with part 1, 2, ...; the parts' lists in order are the whole lists,
# and ``outputs_from`` and ``references_from`` say where in them a part's lists begin.
GENERATED = (
    f"sample_id bigint, part int, history {MESSAGES}, prompt string, "
    "outputs_from bigint, references_from bigint, "
    "outputs array<string>, references array<string>"
)
# The same line as it may come from elsewhere: ids may lack, references may be one text.
GENERATED_LINE = GENERATED.replace("references array<string>", "references string") + ", bad string"
COMPARISON = (
    f"generated struct<sample_id:bigint,history:{MESSAGES}>, "
    "reference struct<reference_response:string,wins:array<boolean>>"
)
EMBEDDED = "run string, sample_id bigint, vectors array<array<double>>"
TRAIN_LOG = (
    "run string, epoch int, batch bigint, rank int, split string, metric string, "
    "value double, n_examples bigint, ts timestamp"
)

# Test tables, as far as the derivations read them.
TABLES = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
        "value double, props string"
    ),
}
