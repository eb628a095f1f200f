"""Training-data operators: token counts, language-model scores, near
duplicates, source mixing, chat formatting, fingerprints, decontamination,
personal data, licences and toxicity.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
