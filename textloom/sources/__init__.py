"""Line and file sources and sinks."""
