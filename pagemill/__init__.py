"""pagemill: DataFrame operators for corpora of paged documents and the notes written from them."""
