from siftline.functions import labels, patterns, text, times, values  # noqa: F401
