"""Operators for preparing text corpora: tokens, duplicates, personal data,
language, chat logs, archives, quality and contamination. Nothing else in the
package imports this subpackage."""
