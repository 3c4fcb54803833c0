"""Stage plans: fitting, prediction, evaluation and whole runs."""
