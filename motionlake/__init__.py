"""PySpark engine for skeletal-motion corpora: DataFrame operators over rigs, clips, frames, joints and captions."""
