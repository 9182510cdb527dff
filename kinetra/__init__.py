"""Motion-sequence analytics as Spark plans: skeletal clips in, model-ready tensors out."""
