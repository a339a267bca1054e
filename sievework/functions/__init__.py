"""Part of the scanning engine."""
