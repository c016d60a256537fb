"""The feature sets of the structured experiments."""

# The four feature sets of the structured experiments.
EXPERIMENT_FEATURES = {
    "Exp-A: All 11 features": [
        "diff_length", "func_before_length", "cyclomatic_complexity", "num_parameters", "num_function_calls",
        "nesting_depth", "token_diversity", "security_keyword_count", "comment_ratio", "lines_added",
        "lines_removed"],
    "Exp-B: No patch-size (lines_added/removed)": [
        "diff_length", "func_before_length", "cyclomatic_complexity", "num_parameters", "num_function_calls",
        "nesting_depth", "token_diversity", "security_keyword_count", "comment_ratio"],
    "Exp-C: Structural + complexity (honest enriched)": [
        "func_before_length", "cyclomatic_complexity", "num_parameters", "num_function_calls",
        "nesting_depth", "token_diversity", "comment_ratio"],
    "Exp-D: Complexity only (no size at all)": [
        "cyclomatic_complexity", "num_parameters", "num_function_calls", "nesting_depth",
        "token_diversity", "comment_ratio"],
}
