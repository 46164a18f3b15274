"""Transform, normalisation, classifiers and evaluation."""
