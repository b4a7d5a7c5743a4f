from tableflow.streaming.absorb import absorb_stream, read_absorbed, read_winners  # noqa: F401
