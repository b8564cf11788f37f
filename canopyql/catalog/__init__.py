"""Information models: loading, resolution and what is generated from them."""
