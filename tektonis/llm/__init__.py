"""Operators for text corpora: canonical values, scan repair, leaked passages, mixing and sentences."""
