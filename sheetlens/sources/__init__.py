"""Sources: workbook files, manifests, log text, run-history files."""
