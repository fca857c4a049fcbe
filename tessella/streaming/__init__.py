"""Windows over event streams: the same functions serve a DataFrame and a stream."""
