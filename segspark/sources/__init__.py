"""Where segments live: file system primitives, segment log, generations, interchange formats."""
