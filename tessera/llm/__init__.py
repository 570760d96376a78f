"""Operators for preparing training corpora: ten stand-alone DataFrame operators and their queries."""
