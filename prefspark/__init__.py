"""Preference-data work on Spark: examples, scores and evaluation tables.

Operators take and return DataFrames; functions take and return Columns.
"""

from .functions.chat import pick_template, render
from .functions.judging import clean_response
from .operators.adapters import adapt, register_adapter, to_paired, to_prompt_only, to_unpaired
from .operators.asking import answers_of, ask_once
from .operators.diversity import diversity, mean_std_err, row_diversity
from .operators.encoding import build_labels, encode, encode_prompts, pad_batches, tokenize, truncate
from .operators.epochs import EpochOrder, epoch_batches
from .operators.flow import flow_metrics, flow_scores
from .operators.grouping import generation_records, group_references, ordered_lists
from .operators.judging import (
    judge_requests,
    judge_until,
    sample_comparisons,
    slot_win_rates,
    verdicts,
    win_summary,
)
from .operators.logits import flow_sequences, shard_logits, sharded_logps, slide_counted
from .operators.metrics import (
    count_examples,
    eval_mean,
    examples_seen,
    interval_means,
    metrics_wide,
    reduce_ranks,
    throughput,
)
from .operators.numbering import (
    assign_batches,
    first_shuffled,
    row_numbers,
    running_stats,
    running_sums,
    shuffled_numbers,
    take_proportion,
)
from .operators.plugins import embed, generate, judge
from .operators.preference import (
    batch_means,
    join_scores,
    pair_scores,
    preference_scores,
    register_loss,
    score_name,
    sequence_logp,
    sft_nll,
    stack_sides,
    token_logps,
)
from .operators.turns import example_rows, histories, messages
from .sources.corpora import dataset_len, get_rows, load_preferences, scan_columns, split_name, write_by_key
from .sources.ledger import Ledger
from .sources.records import (
    read_comparisons,
    read_generations,
    read_metrics,
    write_comparisons,
    write_generations,
    write_json,
    write_metrics,
)
from .streaming.metrics import stream_eval_stats, stream_train_metrics, stream_win_stats

__all__ = [name for name in dir() if not name.startswith("_")]
