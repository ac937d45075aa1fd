"""Training-data operators: toxicity, packing, language-model scores, secrets,
line and near-duplicate removal, personal data, mixing, fingerprints and media.

Nothing outside this subpackage imports it.  Each operator module has a general
function (its own interface) and a thin ``query`` function for the registered query.
"""
